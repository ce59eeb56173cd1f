"""Personal data: strict base patterns, and further spans chosen by boosted trees among overlapping candidates.

Generators of high recall propose spans that may overlap: written-out addresses, numbers that could be phones, cards or
network addresses. A candidate is confirmed when the strict pattern of its own kind finds the same span, and ruled out when
it fails a check or is plainly something else (a version, page, date, ISBN, list of numbers). The rest, plausible and found
by no strict pattern, has no label. Boosted trees learn confirmed against ruled out on three quarters of all such candidates,
weighted by kind and label, from grouping and context: what only the strict pattern asks for (@, +, check digits, octets) is
hidden from them. A kind's threshold is set on the other quarter, held out of the fit, so that at least ``PRECISION`` of those
above it are confirmed. Plausible candidates above it that no base span touches are added.

Spans are counted in code points, end exclusive. A null text is an empty one. Repeated rows are judged each on their own.
Where there is no confirmed candidate to learn from, or no other, nothing can be learned and nothing is added. A kind whose threshold
fewer than ``LEAST_SHOWN`` held-out candidates support gets none, and nothing of it is added: what the trees add depends on how
much the table shows them, so the same text can gain a span in a large table and none in a small one. Base spans do not.
Base patterns are matched, and candidates held against base spans, in time proportional to the text (but for a logarithm),
also where one run of digits or letters fills it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.runtime import ship, written
from rosterlake.llm.words import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_like", "ip_like", "card_like", "phone_like")
#: What all learned candidates weigh at most, the same for each kind and label; however little they weigh, none is left out.
SAMPLE_ROWS = 50_000
TREES, DEPTH = 10, 4
#: Of held-out candidates above a kind's threshold, the share that must be confirmed; and how many there must be.
PRECISION, LEAST_SHOWN = 0.98, 20
SPAN = "struct<kind:string,place:int,start:int,end:int>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: What might be personal data, by the kind that it would be added as.
GENERATORS = (
    ("email_like", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,8}")),
    ("ip_like", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,4}(?:[.,] ?[0-9]{1,4}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])")),
    ("card_like", re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[ ./-]?[0-9]{2,6}){2,5}(?![0-9A-Za-z])")),
    ("phone_like", re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9]{1,5}(?:[ ()./-]{0,3}[0-9]{2,5}){1,5}(?![0-9A-Za-z])")),
)
_HINTS = (
    re.compile(r"mail|contact|write|courriel|correo", re.I), re.compile(r"phone|tel|call|fax|mobile|whatsapp", re.I),
    re.compile(r"card|visa|credit|iban|account|pay", re.I), re.compile(r"\bip\b|host|server|address|addr", re.I),
    re.compile(r"version|license|licen[cs]e|release|v\.|section|page|isbn|copyright", re.I),
)
_AT, _DOT = re.compile(r" ?(?:@|\(at\)|\[at\]|\{at\}) ?"), re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?")
_DATE = re.compile(r"(?:[12][0-9]{3}([-./])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-./])[0-3]?[0-9]\2(?:[12][0-9])?[0-9]{2})(?![0-9])")
_YEARS = re.compile(r"[12][0-9]{3}(?:[ ,/-]{1,3}[12][0-9]{3})+")
_THOUSANDS = re.compile(r"[0-9]{1,3}(?:([. ])[0-9]{3})(?:\1[0-9]{3})*")
_IPV6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
_OTHER = re.compile(r"(?:version|release|license|licen[cs]e|section|pages?|pp?\.|isbn(?:-1[03])?|issn|copyright|\bv\.?|©)[:# ]*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ can end one local part only: the run before it, from the last match on."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the strict patterns that pass their checks, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def ruled_out(text: str, start: int, end: int, kind: int) -> bool:
    """It fails the checks of its kind, or is plainly something else."""
    span, before = text[start:end], text[max(0, start - 24) : start]
    if kind == 0:
        return not re.fullmatch(r"[A-Za-z][A-Za-z-]*[A-Za-z]", _DOT.split(_AT.split(span, maxsplit=1)[-1])[-1])
    if _OTHER.search(before):
        return True
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == 1:
        if ":" in span:
            return not _IPV6.fullmatch(span)
        return not re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", span) or any(int(g) > 255 for g in span.split("."))
    if kind == 2:
        return not 13 <= len(digits) <= 19 or not luhn(digits)
    if not 7 <= len(digits) <= 15 or _DATE.match(span) or _YEARS.fullmatch(span) or _THOUSANDS.fullmatch(span):
        return True
    if len(digits) == 13 and digits[:3] in ("978", "979") and "+" not in span:
        return True
    hinted = _HINTS[1].search(text[max(0, start - 40) : start])
    return "+" not in span and not hinted and len(re.findall(r"[0-9]+", span)) == 1


class Hints:
    """Where the hinting words of a text stand, found once for all of its candidates."""

    def __init__(self, text: str):
        self.found = [([m.start() for m in h.finditer(text)], [m.end() for m in h.finditer(text)]) for h in _HINTS]

    def around(self, start: int, end: int) -> list[float]:
        """For each kind of hint: 1 for one among the 40 characters before, less a half for one among those after."""
        return [self._in(k, start - 40, start) - 0.5 * self._in(k, end, end + 40) for k in range(len(_HINTS))]

    def _in(self, k: int, low: int, high: int) -> bool:
        starts, ends = self.found[k]
        at = bisect_left(starts, low)
        return at < len(starts) and ends[at] <= high


def features(text: str, start: int, end: int, kind: int, hints: Hints) -> list[float]:
    """Grouping of a candidate and what stands around it, without what tells a strict pattern's matches from the others."""
    span = text[start:end]
    email, address, number = (-1,) * 5, (-1,) * 3, (-1,) * 7
    if kind == 0:
        local, domain = _AT.split(span, maxsplit=1)
        labels = _DOT.split(domain)
        email = (len(local), sum(c.isdigit() for c in local), len(labels), len(labels[-1]), sum(c.isdigit() for c in domain))
    elif kind == 1:
        sizes = [min(len(g), 3) for g in re.findall(r"[0-9A-Fa-f]+", span)][:4]
        address = (len(sizes), max(sizes), min(sizes))
    else:
        sizes = [len(g) for g in re.findall(r"[0-9]+", span)]
        if kind == 3 and span[0] == "+" and len(sizes) > 1 and sizes[0] <= 3:
            sizes = sizes[1:]  # a country code is what local numbers lack
        number = (sum(sizes), min(len(sizes), 5), sizes[-1], max(sizes), min(sizes), span.count("."), span.count("/"))
    return [float(x) for x in (kind, *email, *address, *number, *hints.around(start, end))]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Proposed spans with their features; ``confirmed``: the strict pattern of their kind has found the same; ``out``: ruled out."""
    known = {(a, b): kind for kind, a, b in base}
    starts, ends = [], []  # what base spans cover, in rising stretches
    for a, b in sorted(known):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out, hints = [], None
    if "@" in text or "(at)" in text or "[at]" in text or "{at}" in text or _DIGIT.search(text):
        for k, (kind, pattern) in enumerate(GENERATORS):
            for m in pattern.finditer(text):
                a, b = m.span()
                while text[a] == " ":
                    a += 1
                near = bisect_right(ends, a)
                touched = near < len(starts) and starts[near] < b
                confirmed = known.get((a, b)) == BASE[k]
                no = not confirmed and ruled_out(text, a, b, k)
                hints = hints or Hints(text)
                out.append({"kind": kind, "place": len(BASE) + k, "start": a, "end": b, "confirmed": confirmed, "out": no, "free": not touched and not no, "features": features(text, a, b, k, hints)})
    return out


_SCAN = f"base array<{SPAN}>, candidates array<struct<kind:string,place:int,start:int,end:int,confirmed:boolean,out:boolean,free:boolean,features:array<double>>>"
_SPAN_ARROW = pa.struct([("kind", pa.string()), ("place", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND_ARROW = pa.struct([*_SPAN_ARROW, ("confirmed", pa.bool_()), ("out", pa.bool_()), ("free", pa.bool_()), ("features", pa.list_(pa.float64()))])


def scanned(docs: DataFrame, column: str = "text") -> DataFrame:
    """``row``, the columns but the text, base spans and candidates."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (column, "row", "base", "candidates")]
    source = docs.select(F.monotonically_increasing_id().alias("row"), *kept, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 4 << 20):
                base, found = [], []
                for text in part[column].to_pylist():
                    spans = base_spans(text or "")
                    base.append([{"kind": k, "place": BASE.index(k), "start": a, "end": b} for k, a, b in spans])
                    found.append(candidates(text or "", spans))
                yield pa.RecordBatch.from_arrays(
                    [part["row"], *[part[c] for c in kept], pa.array(base, pa.list_(_SPAN_ARROW)), pa.array(found, pa.list_(_FOUND_ARROW))],
                    names=["row", *kept, "base", "candidates"],
                )

    from pyspark.sql.types import StructType

    schema = StructType(source.drop(column).schema.fields + StructType.fromDDL(_SCAN).fields)
    return source.mapInArrow(run, schema)


def select(found: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """Of candidate rows those that the trees select, or nothing where there is nothing to learn."""
    labelled = F.col("confirmed") | F.col("out")
    counts = {(r.kind, r.confirmed): r.n for r in found.filter(labelled).groupBy("kind", "confirmed").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({c for _, c in counts}) < 2:
        return None
    # all of them are learned from; those of a frequent kind and label weigh less, so that rare ones count beside them
    weights = {f"{kind} {str(c).lower()}": min(1.0, sample_rows / (2 * len(GENERATORS)) / n) for (kind, c), n in counts.items()}
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.concat_ws(" ", "kind", F.col("confirmed").cast("string")))
    ready = found.withColumns({"vector": array_to_vector("features"), "label": F.col("confirmed").cast("double")})
    # a quarter is kept out of the fit and sets the thresholds
    held = F.pmod(F.xxhash64("row", "start", "end", "kind"), F.lit(4)) == 0
    known = ready.filter(labelled)
    learned = known.filter(~held).select("vector", "label", weight.alias("weight"))
    if learned.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3)
    model = trees.fit(learned)
    score = F.round(vector_to_array("probability")[1], 3)
    shown = model.transform(known.filter(held)).select("kind", score.alias("score"), "label").groupBy("kind", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")
    )
    limits: dict[str, float] = {}
    by_kind: dict[str, list] = {}
    for r in shown.collect():  # at most a thousand scores a kind
        by_kind.setdefault(r.kind, []).append(r)
    for kind, rows in by_kind.items():
        n_above = good_above = 0.0
        falling = sorted(rows, key=lambda r: -r.score)
        for r, below in zip(falling, [*(x.score for x in falling[1:]), 0.0]):
            n_above, good_above = n_above + r.n, good_above + r.good
            if n_above >= LEAST_SHOWN and good_above >= PRECISION * n_above and r.score >= 0.5:
                limits[kind] = max(0.5, (r.score + below) / 2)  # no held-out one lies between
    if not limits:
        return None
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("kind"))
    chosen = model.transform(ready.filter("free")).filter(score >= limit)
    return chosen.select("row", F.struct("kind", "place", "start", "end").alias("span"))


def find(docs: DataFrame, column: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns but the text, ``base`` and ``spans`` (base and added), by kind as listed, then start."""
    rows = written(scanned(docs, column), "personal-data")
    found = rows.select("row", F.explode("candidates").alias("_c")).select("row", "_c.*")
    chosen = select(found, sample_rows)
    in_order = lambda c: F.array_sort(c, lambda a, b: F.when(a["place"] != b["place"], a["place"] - b["place"]).otherwise(a["start"] - b["start"]))
    if chosen is None:
        return rows.select(*[c for c in rows.columns if c not in ("row", "candidates")], in_order("base").alias("spans"))
    added = chosen.groupBy("row").agg(F.collect_list("span").alias("added"))
    joined = rows.join(added, "row", "left")
    spans = in_order(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return joined.withColumn("spans", spans).drop("row", "candidates", "added")


def redacted(text: str | Column, spans: str | Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first one counts."""
    text = F.col(text) if isinstance(text, str) else text
    rising = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        new = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] >= done["at"], F.struct(new.alias("out"), s["end"].alias("at"))).otherwise(done)

    folded = F.aggregate(rising, empty, step)
    return F.concat(folded["out"], F.substring(text, folded["at"] + 1, F.length(text)))
