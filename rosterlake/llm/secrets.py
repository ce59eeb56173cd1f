"""Secrets in texts, with a ledger of what has been scanned.

Every text that a path has had is a blob, named by the SHA-256 of its bytes. The ledger holds one row for each blob, rule
and rule version that was ever scanned, with the spans found. A scan reads the texts of blobs for which some pair is
missing, once per blob however many paths share it, runs only the missing rules, appends to the ledger, and joins the
findings back to all paths.

Spans are counted in code points, end exclusive. A null text is an empty one and has no spans. Copies share a blob. Rows
that repeat a path are versions of it, and each keeps its own findings. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.llm.runtime import sha_hex, written

SPAN = "struct<kind:string,place:int,start:int,end:int>"
LEDGER = f"blob string, rule string, version string, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, from the left and without overlap, of which group ``part`` has ``least`` characters or more."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.pattern}\n{self.part}\n{self.least}".encode()).hexdigest()[:16]


#: In the order in which spans that start together are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path, begun empty where there is none. A pair that two scans at once, or a repeated job, have
    appended twice is read once: what a rule's version finds in a blob is the same every time."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rule", "version"])


def _raw(rule: Rule, place: int) -> Column:
    """A rule's matches and the lengths of what stands between them."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    found = F.struct(F.lit(rule.kind).alias("rule"), F.lit(place).alias("place"), hits.alias("hits"), gaps.alias("gaps"))
    return F.when(F.array_contains("todo", rule.kind) & text.rlike(rule.pattern), found)


def scan(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at ``path`` up to date with (blob, text) and return it. Texts of known pairs are not scanned."""
    spark = versions.sparkSession
    known = ledger(spark, path)
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    texts = versions.dropDuplicates(["blob"])
    pairs = versions.select("blob").distinct().select("blob", F.explode(wanted).alias("_w")).select("blob", "_w.*")
    todo = pairs.join(known.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    todo = todo.groupBy("blob").agg(F.collect_set("rule").alias("todo"))
    raw = texts.join(todo, "blob").select("blob", "todo", F.array_compact(F.array(*[_raw(r, i) for i, r in enumerate(rules)])).alias("raw"))
    raw = written(raw, "scan")

    each = raw.select("blob", F.explode("raw").alias("_r")).select("blob", "_r.rule", "_r.place", F.posexplode(F.arrays_zip("_r.hits", "_r.gaps")).alias("n", "_m"))
    before = W.partitionBy("blob", "rule").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.char_length("_m.hits") + F.col("_m.gaps")).over(before), F.lit(0))
    placed = each.filter(F.col("_m.hits").isNotNull()).withColumn("start", (gone + F.col("_m.gaps")).cast("int"))
    long_enough = F.lit(False)
    for rule in rules:
        long_enough = F.when(F.col("rule") == rule.kind, F.char_length(F.regexp_extract("_m.hits", rule.pattern, rule.part)) >= rule.least).otherwise(long_enough)
    good = placed.filter(long_enough).select("blob", "rule", F.struct(F.col("rule").alias("kind"), "place", "start", (F.col("start") + F.char_length("_m.hits")).alias("end")).alias("span"))
    spans = good.groupBy("blob", "rule").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    done = raw.select("blob", F.explode("todo").alias("rule"))
    version = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)]), F.col("rule"))
    done.join(spans, ["blob", "rule"], "left").select(
        "blob", "rule", version.alias("version"), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")
    ).write.mode("append").parquet(path)
    return ledger(spark, path)


def find(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, column: str = "text") -> DataFrame:
    """Add ``blob`` and ``spans`` (kind, place, start, end), by start, then kind as listed, to every row."""
    versions = docs.drop("spans").withColumn("blob", sha_hex(F.coalesce(F.col(column), F.lit(""))))
    book = scan(versions.select("blob", F.coalesce(F.col(column), F.lit("")).alias("text")), path, rules)
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    found = book.filter((F.element_at(current, F.col("rule")) == F.col("version")) & (F.size("spans") > 0))
    found = found.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    in_order = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["place"] - b["place"]))
    return versions.join(found, "blob", "left").withColumn("spans", F.coalesce(in_order, F.array().cast(f"array<{SPAN}>")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
