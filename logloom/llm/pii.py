"""Personal data by generated candidates and boosted trees, in DataFrame expressions only.

Four base kinds are fixed patterns with a check (octets, Luhn, digit counts) and always stay. Three high-recall
generators propose further spans: values given as a credential (of six characters at least), opaque tokens of eight characters at least with a digit
or a known prefix, digit groups, addresses spelled with "at" and "dot", and account numbers.
Every candidate gets format and context features; boosted trees, fitted on drawn examples of a bounded number
(EXAMPLES), score them, and a threshold for each generator, calibrated on held-out examples for PRECISION, selects.
Spans that overlap form an island: one with a base span keeps only its base spans, any other its best candidate.

Matches are leftmost and do not overlap within a kind. Places are code points: the text between matches comes from
split() with the same pattern, and their lengths add up. The patterns are possessive and anchored by what precedes, so
that long runs cost linear time and no deep recursion; they match what the plain forms match.
Nulls and empty texts have no spans; a repeated row gives a row each time. No pattern limits the length of a match. Other
columns of the documents pass through redact() under their own names; `spans`, which it adds, may not be among them.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import boost, common

LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What stands before a value that is given as a credential: its name, and a sign of assignment with or without quotes.
GIVEN = r"(?i:password|passwd|passphrase|pwd|token|secret|api_?key|access_?key|auth|credentials?)[\"']?\x20?[=:]\x20?[\"']?"
ADDED = {
    "secret": rf"(?<={GIVEN})[^\s\"'<>,;]{{6,}}+|(?<![A-Za-z0-9_/+-])(?:(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{{8,}}+={{0,2}}+|(?:gh[pousr]_|sk-|sk_|pk_|xox[bp]-|glpat-)[A-Za-z0-9_-]{{8,}}+)",
    "number": r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,}+(?:[\x20()./-]{1,2}+[0-9]++)++",
    "spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++(?:\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]++)++|\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)++)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,4})?+(?![A-Za-z0-9])",
}
#: A cheap test that a text may hold a match.
MAY = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\."), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]"),
    "secret": lambda t: t.rlike(f"[0-9]|{GIVEN}|gh[pousr]_|sk-|sk_|pk_|xox|glpat"), "number": lambda t: t.rlike("[0-9]{2}"),
    "spelled": lambda t: t.rlike(r"(?i)at[)\]}]|\x20at\x20[A-Za-z0-9-]++\x20dot\x20"), "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
}
KINDS = [*BASE, *ADDED]
CONTEXT, EXAMPLES, PRECISION = 32, 8000, 0.95


def matches(text: Column, kind: str) -> Column:
    """Of a kind the structs (kind, i, gap, value, context): the i-th match and the length and end of what precedes it."""
    pattern = (BASE | ADDED)[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"))
    row = F.transform(both, lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["hit"].alias("value"),
        F.right(x["gap"], F.lit(CONTEXT)).alias("context")))
    return F.when(MAY[kind](text), row)


def luhn(digits: Column) -> Column:
    """Whether the sum is a multiple of ten; digits: a string of them."""
    ds = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    """The base kinds' checks."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    least = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    octets = F.forall(least, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    card = F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    name = {k: F.lit(KINDS.index(k)) for k in BASE}
    return F.when(kind == name["email"], True).when(kind == name["ip"], octets).when(kind == name["card"], card).when(kind == name["phone"], F.length(digits).between(9, 15)).otherwise(False)


WORDS = {
    "credential": "pass(?:word|wd|phrase)|pwd|token|secret|key|auth|bearer|credential", "contact": "phone|tel|call|mobile|cell|fax|contact|whatsapp|ring|dial", "identity": "ssn|social|passport|account|iban|licen[cs]e no|tax id|card|bank",
    "neutral": "page|chapter|version|figure|table|isbn|room|year|vol|section|line|part|score|between|from", "digest": "sha-?[0-9]*|md5|checksum|digest|hash|commit|revision|etag|uuid|guid|id|tree|blob",
}


def iban_holds(value: Column) -> Column:
    """Whether an account number's check digits hold: rearranged and spelled in digits, it leaves 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.when(value.rlike("^[A-Z]{2}[0-9]{2}"), F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def with_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Features of format and context, each a small whole number, from kind, value and context."""
    count = lambda cls: F.length(F.regexp_replace("value", f"[^{cls}]", ""))
    cap = lambda c, n: F.least(c, F.lit(n)).cast("int")
    near = F.lower(F.col("context"))
    features = {
        "f_kind": F.col("kind").cast("int"), "f_length": cap(F.length("value"), 64), "f_digits": cap(count("0-9"), 40), "f_upper": cap(count("A-Z"), 40), "f_lower": cap(count("a-z"), 40),
        "f_hex": F.col("value").rlike("^[0-9a-f]+$").cast("int"), "f_alternations": cap(F.size(F.split(F.col("value"), "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) - 1, 16),
        "f_groups": cap(F.size(F.split(F.col("value"), "[^0-9A-Za-z]+")), 8), "f_key_prefix": F.col("value").rlike("^(?:AKIA|ASIA|gh[pousr]_|sk_|sk-|pk_|xox|glpat-)").cast("int"),
        "f_trunk": F.col("value").rlike(r"^\(?0[1-9]").cast("int"), "f_id_shape": F.col("value").rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$").cast("int"), "f_phone_shape": F.col("value").rlike(r"^\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}$").cast("int"),
        "f_date_shape": F.col("value").rlike("^(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2})$").cast("int"), "f_path": cap(F.length(F.regexp_replace("value", "[^/]", "")), 6),
        "f_words": F.col("value").rlike("^(?:[A-Za-z]+[-_/])*[A-Za-z]+[-_/]?[0-9]{0,4}$").cast("int"), "f_marks": cap(count("^A-Za-z0-9").cast("int"), 8), "f_checked": F.coalesce(iban_holds(F.col("value")), F.lit(False)).cast("int"),
        "f_distinct": cap(F.size(F.array_distinct(F.split(F.col("value"), ""))), 32), "f_assigned": near.rlike(r"[=:]\s{0,2}[\"']?$").cast("int"), "f_quoted": near.rlike("[\"']$").cast("int"),
    } | {f"f_{k}": near.rlike(rf"(?:{w})[^a-z0-9]{{0,4}}(?:[a-z]{{1,8}}[^a-z0-9]{{1,3}}){{0,2}}$").cast("int") for k, w in WORDS.items()}
    return df.withColumns(features), list(features)


def examples(n: int = EXAMPLES, seed: int = 9) -> list[tuple[int, str, str, int]]:
    """Drawn candidates (kind, value, context, label), half of them personal or secret."""
    r = random.Random(seed)
    pick = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))
    word = lambda: pick(string.ascii_lowercase, 2, 9)
    digits = lambda k: pick(string.digits, k, k)
    before = lambda *ends: " ".join(word() for _ in range(3)) + " " + r.choice(ends)
    secret, number, spelled, iban_kind = (KINDS.index(k) for k in ADDED)
    hexes, upper, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    own = lambda: before("token: ", 'password="', "Passwd=", "api_key=", "secret = ", "pwd:", "auth: ", "access_key=")
    prefix = lambda: r.choice(["ghp_", "gho_", "sk_", "sk-", "sk-proj-", "pk_live_", "xoxb-", "glpat-"])
    runs = lambda k: "".join(chars[(start + i) % len(chars)] for chars in [string.ascii_lowercase + string.ascii_uppercase + string.digits] for start in [r.randrange(62)] for i in range(k))
    account = lambda: r.choice(["DE", "FR", "GB", "ES", "NL"])

    def iban(right: bool) -> str:
        country, rest = account(), pick(string.digits, 14, 20)
        spelled_out = int("".join(str(int(c, 36)) for c in rest + country + "00"))
        check = (98 - spelled_out % 97 + (0 if right else r.randint(1, 90))) % 97 or 97
        whole = f"{country}{check:02d}{rest}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if r.random() < 0.5 else whole

    good = [
        lambda: (secret, pick(hexes, 16, 64), before('token = "', "password=", "secret: ", "api_key=", 'auth: "', "key=")),
        lambda: (secret, pick(mixed, 8, 40), own()),
        lambda: (secret, pick(mixed + "/+", 30, 44) + r.choice(["", "=", "=="]), own()),
        lambda: (secret, pick(string.ascii_lowercase, 8, 40), own()),
        lambda: (secret, word() + word() + r.choice("!?#$%&*@") + digits(r.randint(0, 3)), own()),
        lambda: (secret, word().title() + digits(2) + r.choice("!?#$%&*@") + word(), own()),
        lambda: (secret, r.choice(["AKIA", "ASIA"]) + pick(upper, 16, 16), before("", "key ", "")),
        lambda: (secret, prefix() + pick(mixed, 20, 48), before("", "", "use ", "token ")),
        lambda: (secret, prefix() + runs(r.randint(20, 40)), before("", "", "use ")),
        lambda: (secret, pick(mixed + "/+", 40, 40), before("", "key ", "credentials ")),
        lambda: (secret, pick(hexes, 32, 40), before("", 'token = "')),
        lambda: (number, f"{digits(3)}-{digits(2)}-{digits(4)}", before("ssn ", "ssn: ", "social security ", "tax id ", "", "")),
        lambda: (number, r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(digits(3), digits(3), digits(4)), before("call ", "phone: ", "tel. ", "mobile ", "fax ", "fax: ", "ring ")),
        lambda: (number, r.choice(["0{}/{}", "0{} {}", "0{}-{}", "(0{}) {}"]).format(r.randint(20, 9999), digits(r.randint(6, 8))), before("call ", "phone: ", "tel. ", "fax: ", "", "")),
        lambda: (number, f"0{r.randint(1, 9)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", before("call ", "tel: ", "", "fax ")),
        lambda: (spelled, f"{word()}{r.choice([' [at] ', '(at)', '[at]', ' (at) ', ' {at} '])}{word()}{r.choice([' [dot] ', '[dot]', '(dot)', '.'])}{r.choice(['com', 'org', 'net'])}", before("", "mail ", "contact ")),
        lambda: (spelled, f"{word()} {r.choice(['at', 'AT', 'At'])} {word()} {r.choice(['dot', 'DOT'])} {r.choice(['com', 'org', 'net'])}", before("", "mail ", "contact ")),
        lambda: (iban_kind, iban(True), before("", "iban ", "account ", "pay to ")),
    ]
    bad = [
        lambda: (secret, word() + word() + digits(r.randint(1, 2)), before("", "")),
        lambda: (secret, digits(r.randint(8, 20)), before("", "", "page ")),
        lambda: (secret, word() + "_" + word() + "_" + digits(1), before("", "", "table ")),
        lambda: (secret, digits(r.randint(4, 8)) + r.choice(["years", "metres", "pieces"]), before("")),
        lambda: (secret, pick(hexes, *r.choice([(32, 32), (40, 40), (64, 64)])), before("sha256 ", "md5: ", "commit ", "checksum ", "sha1=", "digest: ", "hash ", "etag: ", "revision ")),
        lambda: (secret, pick(hexes, 64, 64), before("")),
        lambda: (secret, "-".join(pick(hexes, k, k) for k in (8, 4, 4, 4, 12)), before("", "id ", "uuid ")),
        lambda: (secret, f"{word()}/{word()}/{r.choice(['', word() + '-'])}{digits(r.randint(1, 4))}", before("", "see ", "in ")),
        lambda: (secret, f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}{r.choice(['', 'T' + digits(2)])}", before("", "on ", "since ")),
        lambda: (secret, f"{word()}-{word()}-{digits(1)}", before("", "the ")),
        lambda: (secret, f"{digits(3)}-{digits(2)}-{digits(4)}", before("table ", "page ")),
        lambda: (number, f"{r.randint(1900, 2030)}{r.choice('-/.')}{digits(2)}{r.choice('-/.')}{digits(2)}", before("", "year ", "on ")),
        lambda: (number, f"{r.randint(1, 28)}{r.choice('./')}{r.randint(1, 12)}{r.choice('./')}{r.randint(1900, 2030)}", before("", "on ", "since ")),
        lambda: (number, f"{r.randint(1, 99)}/{r.randint(1, 99)}", before("", "score ", "page ")),
        lambda: (number, f"{digits(2)}.{digits(2)}", before("", "version ", "figure ")),
        lambda: (number, " ".join(digits(r.randint(2, 4)) for _ in range(r.randint(2, 6))), before("", "table ", "page ")),
        lambda: (number, f"{r.randint(10, 99)}-{r.randint(100, 999)}", before("pages ", "lines ", "", "between ")),
        lambda: (number, f"{digits(3)}-{digits(4)}", before("", "isbn ", "room ", "vol ")),
        lambda: (number, f"97{r.choice('89')}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", before("", "isbn ")),
        lambda: (number, f"({digits(3)}) {digits(3)}-{digits(4)}", before("table ", "page ")),
        lambda: (spelled, f"{word()}[at]{word()}.{digits(3)}", before("")),
        lambda: (spelled, f"{word()} at {word()} dot {digits(1)}", before("", "look ")),
        lambda: (iban_kind, iban(False), before("", "part ", "code ")),
        lambda: (iban_kind, f"{pick(string.ascii_uppercase, 2, 2)}{digits(2)} {digits(4)} {digits(4)}", before("", "table ", "room ")),
    ]
    return [(*r.choice(good if k % 2 else bad)(), k % 2) for k in range(n)]


def model(spark: SparkSession) -> tuple[list[boost.Tree], list[str], dict[int, float]]:
    """Trees, their features and each generator's threshold. The examples are few; their features come from the same expressions as the corpus'."""
    drawn = spark.createDataFrame(examples(), "kind int, value string, context string, label int").coalesce(1)
    table, names = with_features(drawn)
    rows = np.array(table.select(*names, "label").collect(), dtype=np.int64)
    x, y, held = rows[:, :-1], rows[:, -1], np.arange(len(rows)) % 4 > 1
    trees = boost.fit(x[~held], y[~held].astype(float))
    scores = boost.margin(trees, x)
    cut = {}
    for kind in (KINDS.index(k) for k in ADDED):
        own = held & (x[:, 0] == kind)
        cut[kind] = max(0.0, boost.calibrated_cut(scores[own], y[own].astype(float), PRECISION))
    return trees, names, cut


def spans_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, k1, k2, spans) for every row of docs: its sorted structs (kind, start, end, base, score); k1 and k2 as in
    common.with_row_key, of the text or, if it is null, an empty one."""
    trees, names, cut = model(docs.sparkSession)
    rows = common.with_row_key(docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")), "key", "text")
    rows = rows.withColumns({f"m_{k}": matches(F.col("text"), k) for k in KINDS})
    none = F.lit(None).cast("struct<kind:int,i:int,gap:int,value:string,context:string>")
    found = F.concat(F.array(none), *(F.coalesce(f"m_{k}", F.array().cast("array<struct<kind:int,i:int,gap:int,value:string,context:string>>")) for k in KINDS))
    found = common.table(rows.select("key", "k1", "k2", F.explode_outer(found).alias("m")).select("key", "k1", "k2", "m.*"), "pii-matches")

    hits = found.where("kind is not null").drop("key").distinct()
    in_order = W.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(in_order)).withColumn("start", F.col("end") - F.length("value"))
    is_base = F.col("kind") < len(BASE)
    hits = hits.withColumn("base", is_base).where(~is_base | passes(F.col("kind"), F.col("value")))
    hits, _ = with_features(hits)
    # a table, as the trees name each feature many times and Spark would write out its expression each time
    hits = common.table(hits.select("k1", "k2", "kind", "start", "end", "base", *names), "pii-features")
    least = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in cut.items()))
    hits = hits.withColumn("score", F.when(is_base, F.lit(0.0)).otherwise(boost.margin_column(trees, names))).where(is_base | (F.col("score") >= least))

    placed = W.partitionBy("k1", "k2").orderBy("start", "end", "kind")
    before = F.max("end").over(placed.rowsBetween(W.unboundedPreceding, -1))
    hits = hits.withColumn("fresh", (F.coalesce(before, F.lit(-1)) <= F.col("start")).cast("int"))
    hits = hits.withColumn("island", F.sum("fresh").over(placed.rowsBetween(W.unboundedPreceding, W.currentRow)))
    island = W.partitionBy("k1", "k2", "island")
    hits = hits.withColumn("has_base", F.max("base").over(island)).withColumn("nth", F.row_number().over(island.orderBy(F.desc("score"), "start", "kind")))
    kept = hits.where("base or (not has_base and nth = 1)")
    per = kept.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base", "score"))).alias("spans"))
    return found.where("kind is null").select("key", "k1", "k2").join(per, ["k1", "k2"], "left").select("key", "k1", "k2", "spans")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets (overlapping base spans become one of the first
    kind), and the column `spans`. A null text stays null."""
    if "spans" in docs.columns:
        raise ValueError("column spans is the result's own; rename it first")
    k1, k2 = common.fresh(docs, "k1", "k2")
    spans = spans_of(docs, key, text).select(F.col("k1").alias(k1), F.col("k2").alias(k2), "spans").distinct()
    whole = F.coalesce(text, F.lit(""))
    ident = docs.withColumns({k1: F.xxhash64(key, whole), k2: F.xxhash64(F.lit("#"), whole, key)})
    return ident.join(spans, [k1, k2], "left").withColumn(text, redacted(F.col(text), F.col("spans"))).select(*docs.columns, "spans")


def redacted(text: Column, spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")).alias("out"), s["end"].alias("at")))
    done = F.aggregate(ordered, start, step)
    whole = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    return F.when(spans.isNull(), text).otherwise(whole)


def op9(docs: DataFrame) -> DataFrame:
    spans = spans_of(docs.select("doc_id", "text")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    n = lambda k: F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))), F.lit(0))
    counts = [F.greatest(n(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select(F.col("key").alias("doc_id"), *counts, F.sha2(F.coalesce(joined(F.col("base")), F.lit("")), 256).alias("base_sha256"), F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"))
