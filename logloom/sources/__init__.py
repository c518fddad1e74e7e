"""Where tables come from: views over plain tables, bag folders, JSON documents, MCAP files and vector shards."""
