"""Secret scan by corpus-wide ownership frequency (operator 13).

One pass over the whole texts finds candidates.  Base spans are those of three
plain patterns (`assign`, `access`, `hex`); they are always reported.  Beside them
every token of 8 characters or more that holds letters and digits is a candidate,
weak by itself; it is strong if it is 20 characters or more, of three character
classes and of at least `entropy` bits a character.

Ownership.  A candidate leaves the pass as a 128-bit hash of its value with its
place, repository and owner.  Over the whole corpus the distinct repositories and
owners of each hash are counted: first distinct (hash, owner, repository), then
repositories by (hash, owner), then by hash, each reduced before it is shuffled.
Values of many owners or repositories are examples that people copy; values of one
owner that do not look like a placeholder are live-looking; what lies between is
`shared`.  The verdict goes back to each (hash, salt) present, so an example that
a third of all documents copy does not meet in one task.

Added spans (kind `owned`): tokens outside every base span whose value is live -
one owner's alone - and either strong or caught by a base pattern somewhere else,
as when a password stands with its name in one file and bare in another.

Cases: null text: the empty text, no spans.  Null doc_id: kept as null; without a
repository column of its own each such row is one repository.  Null owner: an owner
of its own.  Repeated rows: each is reported; equal ids are one repository.  Equal
starts: kinds in the order `assign`, `access`, `hex`, `owned`.  Very long texts:
whole.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import give_back, materialize

KINDS = ("assign", "access", "hex", "owned")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = ("password", "passwd", "secret", "token", "api_?key")
_VALUE = r"A-Za-z0-9+/_.=-"
ASSIGN = re.compile("(" + "|".join(map(_either_case, _NAMES)) + r")[\"']?\x20*[:=]\x20*[\"']?([" + _VALUE + "]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
#: A maximal run of value characters that holds a digit.
TOKEN = re.compile(f"(?<![{_VALUE}])(?=[A-Za-z+/_.=-]*[0-9])[{_VALUE}]{{8,}}")
#: No match of ASSIGN without one of these in the lower-cased text.
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LETTER = re.compile("[A-Za-z]")
_CLASSES = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]", "[+/_=-]")))
#: Parts of values that tell a placeholder.
_PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your[_-]|x{6}|\.{3}|12345678|abcdefgh", re.I)


@dataclass(frozen=True)
class Params:
    most_owners: int = 1  # of a live value
    example_owners: int = 4  # from so many owners on, an example
    example_repositories: int = 50
    strong_length: int = 20
    entropy: float = 3.2  # bits a character
    salts: int = 64


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def placeholder(value: str) -> bool:
    """Values that nobody uses: named as such, or of very few different characters."""
    return bool(_PLACEHOLDER.search(value)) or len(set(value)) < 4


def strong(value: str, p: Params = Params()) -> bool:
    return len(value) >= p.strong_length and sum(bool(c.search(value)) for c in _CLASSES) >= 3 and entropy(value) >= p.entropy


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the three base patterns, leftmost and without overlap for each."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span(), m[2].rstrip(".")) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def token_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the tokens that touch no base span."""
    out, k, reach = [], 0, -1
    for m in TOKEN.finditer(text):
        lo, value = m.start(), m[0].rstrip(".")
        hi = lo + len(value)
        while k < len(base) and base[k][1] < hi:
            reach = max(reach, base[k][2])
            k += 1
        if len(value) >= 8 and reach <= lo and _LETTER.search(value):
            out.append(("owned", lo, hi, value))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary()), ("strong", pa.bool_()), ("fake", pa.bool_())])
_SPAN_SQL = "struct<kind:string,start:long,end:long,hash:binary,strong:boolean,fake:boolean>"


def _found(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        for b in batches:
            spans = []
            for text in b.column("text").to_pylist():
                base = base_spans(text) if text else []
                both = base + token_spans(text, base) if text else []
                spans.append([
                    {"kind": k, "start": lo, "end": hi, "hash": hashlib.blake2b(v.encode(), digest_size=16).digest(), "strong": k == "owned" and strong(v, p), "fake": placeholder(v)}
                    for k, lo, hi, v in both])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + b.num_rows), pa.int64()), b.column("doc_id"), b.column("repository"), b.column("owner"), pa.array(spans, pa.list_(_SPAN))],
                names=["row", "doc_id", "repository", "owner", "spans"])
            row += b.num_rows

    return run


def candidates(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, p: Params = Params()) -> DataFrame:
    """Written rows of docs (doc_id, text): row, doc_id, repository, owner, spans (base ones and all tokens).

    Without repository a document is one; without owner its source is."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("doc_id") if repository is None else repository).cast("string").alias("repository"),
        F.coalesce((F.col("source") if owner is None else owner).cast("string"), F.lit("")).alias("owner"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_found(p), f"row long, doc_id long, repository string, owner string, spans array<{_SPAN_SQL}>"), "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """candidates() -> for each hash: n_repositories, n_owners, named (a base pattern caught it somewhere), fake."""
    repository = F.coalesce(F.concat(F.lit("="), F.col("repository")), F.col("row").cast("string"))
    each = found.select("owner", repository.alias("repository"), F.explode("spans").alias("s")).select("owner", "repository", "s.hash", (F.col("s.kind") != "owned").alias("named"), "s.fake")
    once = each.groupBy("hash", "owner", "repository").agg(F.max("named").alias("named"), F.max("fake").alias("fake"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("named").alias("named"), F.max("fake").alias("fake"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.max("named").alias("named"), F.max("fake").alias("fake"))


def verdict(p: Params = Params()) -> Column:
    """Of an ownership() row: example, live or shared."""
    many = (F.col("n_owners") >= p.example_owners) | (F.col("n_repositories") >= p.example_repositories)
    return F.when(many | F.col("fake"), "example").when(F.col("n_owners") <= p.most_owners, "live").otherwise("shared")


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, p: Params = Params()) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, spans: kind, start, end, verdict, n_owners, n_repositories, by start, then kind."""
    found = candidates(docs, repository, owner, p)
    known = materialize(ownership(found).select("hash", "n_repositories", "n_owners", "named", verdict(p).alias("verdict")), "secret-ownership")
    each = found.select("row", "doc_id", F.explode("spans").alias("s")).select("row", "doc_id", "s.kind", "s.start", "s.end", "s.hash", "s.strong", F.pmod("row", F.lit(p.salts)).cast("int").alias("salt"))
    each = give_back(each, "hash", "salt", known)
    each = each.filter((F.col("kind") != "owned") | ((F.col("verdict") == "live") & (F.col("strong") | F.col("named"))))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", rank.alias("rank"), "kind", "end", "verdict", "n_owners", "n_repositories")
    spans = each.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("x"))  # a document's spans, bounded by its text
    empty = "array<struct<kind:string,start:long,end:long,verdict:string,n_owners:long,n_repositories:long>>"
    names = ("kind", "start", "end", "verdict", "n_owners", "n_repositories")
    plain = F.transform("x", lambda s: F.struct(*[s[c].alias(c) for c in names]))
    with_some = found.filter(F.size("spans") > 0).select("row", "doc_id").join(spans, "row", "left")
    some = with_some.select("doc_id", F.coalesce(plain, F.array()).cast(empty).alias("spans"))
    return some.union(found.filter(F.size("spans") == 0).select("doc_id", F.array().cast(empty).alias("spans")))


def digests(found: DataFrame) -> DataFrame:
    """scan() -> a narrow row for each document: counts of base spans, their digest, all spans as text, numbers by verdict."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    text = lambda a: F.concat_ws(",", F.transform(a, line))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    judged = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "owned")
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        judged("live").alias("n_live"), judged("example").alias("n_example"))
