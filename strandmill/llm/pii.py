"""Personal data by weak supervision, in DataFrame and SQL expressions only.

Linear-time patterns propose candidates: those of the four base kinds, which
always stay, and looser ones.  Regex, gazetteer, context and shape labelers vote
(1, 0 or -1) on every candidate.  Votes are counted by pattern over the whole
corpus; expectation-maximisation on that count table estimates each labeler's
reliabilities, and a logistic span classifier is trained on the posteriors and
then applied to every candidate as a column expression.  The count table has at
most kinds * 3^4 * 4 rows however large the corpus is; nothing else reaches the
driver.

Offsets are code points.  They come from the lengths of the pieces between the
matches, summed by a window over the candidates of a row; texts never shuffle.

Defined cases.  Null or empty text: no span.  Repeated rows: each has its own
spans.  Ties cannot occur within a kind, and spans of different kinds may
overlap.  No candidate anywhere: no model, no added span.  Empty table: empty
result.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, stored

#: Name, pattern and a character that every match holds.  The patterns find the
#: leftmost non-overlapping matches of the plain forms; possessive quantifiers
#: and lookbehind keep them from rescanning a run.
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("mail_spelt", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,64}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,64}+)+", None),
    ("phone_local", r"(?<![0-9+().-])(?<![0-9+] )(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])(?![-.][0-9])", None),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])(?!-[0-9])", "-"),
)
KINDS = tuple(name for name, _, _ in PATTERNS)
BASE = 4
#: Gazetteers and cue words (fixed values).
DOMAINS = "com org net edu gov io info biz de fr es uk eu us ca au it nl ch at".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 63 64 65 66 81 82 84 86 90 91 351 353 358 420".split()
CARD_PREFIXES = "4 51 52 53 54 55 34 37 6011 65 35 62 2221 2720".split()
CUES = {
    "email": "mail|contact|write|reach|kontakt|contacto|courriel|correo",
    "ip": r"\bip\b|host|server|login|client|from|serveur",
    "card": "card|visa|credit|payment|karte|tarjeta|carte|amex",
    "phone": "call|phone|tel|mobile|fax|ring|contact|anruf|llam|appel",
    "mail_spelt": "mail|contact|write|reach|kontakt|contacto|courriel|correo",
    "phone_local": "call|phone|tel|mobile|fax|ring|contact",
    "ssn": r"ssn|social|security|tax|\bid\b",
}
AGAINST = r"version|section|chapter|isbn|invoice|order|figure|table|release|build|example|sample|part no"
CONTEXT = 40


def _candidates(text: Column, rank: int, pattern: str, needs: str | None) -> Column:
    """Array of (kind, gap, value, before): gap is the length of the piece before the match."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.transform(
        matches,
        lambda m, i: F.struct(F.lit(rank).alias("kind"), F.char_length(F.get(pieces, i)).alias("gap"), m.alias("value"), F.lower(F.right(F.get(pieces, i), F.lit(CONTEXT))).alias("before")),
    )
    test = F.contains(text, F.lit(needs)) if needs else F.lit(True)
    return F.when(test & text.rlike(pattern), zipped)


def _luhn(digits: Column) -> Column:
    """Whether the digit string passes the Luhn test."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(places, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, key, found): every row of ``docs`` with its candidates in order of kind, then place."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key"))
    for rank, (name, pattern, needs) in enumerate(PATTERNS):
        rows = rows.withColumn(name, _candidates(F.col("text"), rank, pattern, needs))
    found = F.flatten(F.array_compact(F.array(*KINDS)))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", F.when(F.size(found) > 0, found).alias("found")), "candidates")


def spans(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, base, votes...) of every candidate."""
    each = found.where("found is not null").select("row", F.posexplode("found").alias("at", "c")).select("row", "at", "c.*")
    place = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("value")
    each = each.withColumn("end", F.sum(F.col("gap") + size).over(place).cast("int")).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.char_length(digits)
    kind = F.col("kind")
    parts = F.transform(F.split("value", r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))) + F.when(F.char_length(F.ltrim(p, F.lit("0"))) == 3, (F.ltrim(p, F.lit("0")) > "255").cast("int")).otherwise(0))
    octets = ~F.exists(parts, lambda p: p > 3)
    base = F.when(kind == 0, True).when(kind == 1, octets).when(kind == 2, _luhn(digits)).when(kind == 3, n.between(9, 15)).otherwise(False)
    each = each.withColumn("digits", digits).withColumn("base", base)
    area = F.substring("digits", 1, 3)
    regex = F.when(kind < BASE, F.when(F.col("base"), 1).otherwise(-1)).otherwise(1)
    calling = F.coalesce(*[F.when(F.col("digits").startswith(c), True) for c in CALLING_CODES], F.lit(False))
    prefix = F.coalesce(*[F.when(F.col("digits").startswith(c), True) for c in CARD_PREFIXES], F.lit(False))
    top = F.lower(F.regexp_extract("value", r"([A-Za-z]+)$", 1))
    private = F.col("value").rlike(r"^(?:0|127|255)\.")
    gazetteer = (
        F.when(kind.isin(0, 4), F.when(top.isin(DOMAINS), 1).otherwise(0))
        .when(kind == 1, F.when(private, -1).otherwise(0))
        .when(kind == 2, F.when(prefix, 1).otherwise(-1))
        .when(kind == 3, F.when(calling, 1).otherwise(-1))
        .when(kind == 5, F.when(F.substring("digits", 1, 1).isin("0", "1"), -1).otherwise(1))
        .otherwise(F.when(area.isin("000", "666") | area.startswith("9"), -1).otherwise(1))
    )
    cue = F.coalesce(*[F.when((kind == k) & F.col("before").rlike(CUES[name]), True) for k, name in enumerate(KINDS)], F.lit(False))
    context = F.when(cue, 1).when(F.col("before").rlike(AGAINST), -1).otherwise(0)
    variety = F.size(F.array_distinct(F.split("digits", "")))
    shape = F.when((n > 0) & (variety <= 2) & (kind != 0) & (kind != 4), -1).when(variety >= 5, 1).otherwise(0)
    length = F.least(F.lit(3), F.floor(size / 10)).cast("int")
    return each.select("row", "kind", "start", "end", "base", regex.alias("v_regex"), gazetteer.alias("v_gazetteer"), context.alias("v_context"), shape.alias("v_shape"), length.alias("length"))


VOTES = ("v_regex", "v_gazetteer", "v_context", "v_shape")


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of each vote pattern by expectation-maximisation: a prior for each kind, a vote table for each labeler and class."""
    start = 1 / (1 + np.exp(-votes.sum(axis=1)))
    post = start
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.array([(((post + 0.0) * counts)[kinds == k].sum() + 1) / (counts[kinds == k].sum() + 2) for k in range(len(KINDS))])
        for c, weight in enumerate(((1 - post) * counts, post * counts)):
            for v in range(votes.shape[1]):
                for x in (-1, 0, 1):
                    table[v, c, x + 1] = weight[votes[:, v] == x].sum() + (3.0 if x == (1 if c else -1) else 1.0)
        share = table / table.sum(axis=2, keepdims=True)
        logs = [np.log(p) + sum(np.log(share[v, c, votes[:, v] + 1]) for v in range(votes.shape[1])) for c, p in enumerate((1 - prior[kinds], prior[kinds]))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))
    return post


def classifier(rows: list, steps: int = 400) -> dict[str, float]:
    """Weights of a logistic span classifier trained on the posteriors of counted patterns (kind, votes, length, count)."""
    kinds = np.array([r[0] for r in rows])
    votes = np.array([r[1:5] for r in rows]).reshape(-1, 4)
    lengths = np.array([r[5] for r in rows])
    counts = np.array([r[6] for r in rows], float)
    post = reliabilities(kinds, votes, counts)
    names = [f"kind={k}" for k in range(len(KINDS))] + [f"{v}={x}" for v in VOTES for x in (-1, 0, 1)] + [f"length={n}" for n in range(4)]
    x = np.concatenate([kinds[:, None] == np.arange(len(KINDS)), *[votes[:, v : v + 1] == np.array([[-1, 0, 1]]) for v in range(4)], lengths[:, None] == np.arange(4)], axis=1).astype(float)
    weight = counts / counts.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.5 * (x.T @ (weight * (p - post)) + 1e-4 * w)
    return dict(zip(names, w.tolist()))


def margin(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        column, value = name.split("=")
        total = total + F.when(F.col(column) == int(value), F.lit(w)).otherwise(0.0)
    return total


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the rows of ``docs`` (row, doc_id, key) and their accepted spans (row, kind, start, end, base, probability)."""
    found = candidates(docs, id_col, text_col)
    each = stored(spans(found), "spans")
    patterns = each.groupBy("kind", *VOTES, "length").count().collect()
    weights = classifier([tuple(r) for r in patterns]) if patterns else {}
    scored = each.withColumn("probability", 1 / (1 + F.exp(-margin(weights))))
    kept = scored.where(F.col("base") | ((F.col("kind") >= BASE) & (F.col("probability") >= threshold)))
    return found.select("row", "doc_id", "key"), kept.select("row", "kind", "start", "end", "base", "probability")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the base spans of every row, and all its spans."""
    rows, each = detect(docs, id_col, text_col)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spelt = F.struct("kind", "start", F.concat_ws(":", name, "start", "end").alias("span"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["span"]), ",")
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{n}") for k, n in enumerate(KINDS[:BASE])]
    known = each.groupBy("row").agg(*counts, joined(F.when(F.col("base"), spelt)).alias("base_spans"), joined(spelt).alias("spans"))
    out = rows.join(known, "row", "left")
    zero = [F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in KINDS[:BASE]]
    return out.select("doc_id", *zero, F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with each accepted span replaced by its kind in angle brackets; overlapping spans give way to the earlier, longer one.

    Null and empty texts and rows without spans stay as they are; repeated rows
    are redacted alike; columns of any other name pass through.
    """
    rows, each = detect(docs, id_col, text_col)
    key, spans_ = free_name(docs, "_key"), free_name(docs, "_spans")
    found = each.join(rows.select("row", "key"), "row").groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("stop"), "kind"))).alias(spans_))
    found = found.groupBy(F.col("key").alias(key)).agg(F.max(spans_).alias(spans_))
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    name = lambda k: F.element_at(F.array(*[F.lit(f"<{x.upper()}>") for x in KINDS]), k + 1)
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct((-s["stop"]).alias("at"), F.concat(a["text"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), name(s["kind"])).alias("text"))
    )
    clean = F.aggregate(spans_, zero, step, lambda a: F.concat(a["text"], F.substring(text, a["at"] + 1, F.char_length(text))))
    joined = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), text)).join(found, key, "left")
    return joined.withColumn(text_col, F.when(F.col(spans_).isNull(), text).otherwise(clean)).select(docs.columns)
