"""Secret scans with corpus-wide ownership frequency.

Each text yields base spans (assignments, access keys, hexadecimal runs) and
further high-entropy tokens.  The hashes of all their values are counted over
the corpus by distinct owners and repositories: a value that several owners
carry, or one owner in more than MOST_REPOS repositories, is a copied example;
any other looks live.  Live tokens become spans of their own; base spans always
stay, and every candidate has its own verdict and both frequencies.

Distinct (hash, owner, repository) rows are formed before any count, and the
verdict of a value in very many texts is dealt to them in pieces.

Defined cases.  Null or empty text: no span.  A null owner or repository is one
like any other.  Repeated rows: each has its spans; equal (owner, repository)
count once.  Empty table: empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_keys, spread_join, stored

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9_-]{20,}")
KINDS = ("assign", "access", "hex", "token")
#: What a text must hold for any span at all, in the linear-time dialect.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9_-]{20}"""
ENTROPY = 3.5
#: A live value has at most so many owners and repositories.
MOST_OWNERS, MOST_REPOS = 1, 3
CANDIDATE = pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of kind, end, value) in order."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def token_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Mixed-case alphanumeric runs of high entropy that no base span touches."""
    out = []
    for m in TOKEN.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) >= ENTROPY:
            if not any(s < m.end() and m.start() < e for s, _, e, _ in taken):
                out.append((m.start(), 3, m.end(), v))
    return out


def spelled(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """Every row with its base counts and digest, and all its candidates."""
    schema = "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<rank:int,start:int,end:int,hash:binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pc.match_substring_regex(batch.column("text"), ANY)
            counts, digests, found = [], [], []
            for at, maybe in enumerate(hit.to_pylist()):
                base, rest = [], []
                if maybe:
                    text = batch.column("text")[at].as_py()
                    base = base_spans(text)
                    rest = token_spans(text, base)
                kinds = Counter(k for _, k, _, _ in base)
                counts.append((kinds[0], kinds[1], kinds[2]))
                digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                found.append([{"rank": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).digest()[:16]} for s, k, e, v in base + rest])
            arrays = [batch.column(c) for c in ("doc_id", "owner", "repo")] + [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(digests, pa.string()), pa.array(found, pa.list_(CANDIDATE))], names=[f.split()[0] for f in schema.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos) from candidate rows (hash, owner, repo)."""
    once = found.select("hash", "owner", "repo").distinct()
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """Spans and ownership verdicts of every row; values with at most ``most_owners`` owners and ``most_repos`` repositories look live.

    ``verdicts`` has kind:start:end:verdict:owners:repositories of every
    candidate, tokens that are no span included, in order of start, then kind.
    """
    rows = stored(candidates(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.select("row", "owner", "repo", F.explode("found").alias("c")).select("row", "owner", "repo", "c.*")
    owned = ownership(each)
    spread = hot_keys(each.groupBy("hash").count(), "hash")
    judged = spread_join(each, owned, "hash", spread, "row").withColumn("live", (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos))
    spelt = F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1), "start", "end")
    said = F.concat_ws(":", spelt, F.when(F.col("live"), "live").otherwise("copied"), "owners", "repos")
    kept = F.when(F.col("live") | (F.col("rank") < 3), F.struct("start", "rank", spelt.alias("span")))
    listed = lambda spans: F.array_join(F.transform(F.array_sort(F.collect_list(spans)), lambda s: s["span"]), ",")
    known = judged.groupBy("row").agg(
        listed(kept).alias("spans"),
        listed(F.struct("start", "rank", said.alias("span"))).alias("verdicts"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    out = rows.drop("found").join(known, "row", "left")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("spans", "verdicts")]
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", *blank, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied")])
