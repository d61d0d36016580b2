"""Secret scan over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over lower-cased trigrams that any match must contain.
Texts are indexed block by block inside the tasks (postings of just the trigrams that some rule asks for), postings are
intersected and united as the query says, and only the candidates are verified with the expression itself. A rule from
which no mandatory trigram follows scans every text.

Cases: null and empty texts have no spans; null ids stay; repeated rows each get a row; an empty table gives none;
further columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
import re._constants as K
import re._parser as P
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.llm.common import raw, slices, table

#: Strings that a finite part of an expression may stand for before its trigrams are drawn.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """least: characters that group `group` of a match must have, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    base: bool = False

    def compiled(self, kind: type):
        flags = re.IGNORECASE | re.ASCII if self.any_case else re.ASCII
        return re.compile(self.pattern.encode() if kind is bytes else self.pattern, flags)


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, False, True),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", any_case=True),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + EXTRA

#: A query is None (says nothing), a trigram, or ("and" | "or", parts).
Query = None | bytes | tuple


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What texts that hold one of the strings must contain."""
    return _any([_all([s[i : i + 3].encode() for i in range(len(s) - 2)]) for s in sorted(strings)])


def _parts(tree) -> tuple[set[str] | None, Query]:
    """All strings that the tree can match if they are few, else None; and a query that every match fulfils."""
    now, queries, whole = {""}, [], True
    for op, arg in tree:
        exact, query = _one(op, arg)
        if exact is not None and len(now) * len(exact) <= MAX_STRINGS:
            now = {a + b for a, b in product(now, exact)}
            continue
        queries += [_of_strings(now), query if exact is None else None]
        now, whole = exact if exact is not None and len(exact) <= MAX_STRINGS else {""}, False
    queries.append(_of_strings(now))
    return (now if whole else None), _all(queries)


def _one(op, arg) -> tuple[set[str] | None, Query]:
    if op is K.LITERAL:
        return {chr(arg).lower()}, None
    if op is K.AT:
        return {""}, None
    if op is K.IN and all(o is K.LITERAL for o, _ in arg):
        return {chr(c).lower() for _, c in arg}, None
    if op is K.SUBPATTERN:
        return _parts(arg[-1])
    if op is K.BRANCH:
        got = [_parts(x) for x in arg[1]]
        if all(e is not None for e, _ in got):
            return set().union(*(e for e, _ in got)), _any([q for _, q in got])
        return None, _any([q for _, q in got])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        low, high, tree = arg
        exact, query = _parts(tree)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, None
        if exact is not None and low == high and len(exact) ** low <= MAX_STRINGS:
            return {"".join(x) for x in product(exact, repeat=low)}, None
        return None, query if low else None
    return None, None


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression; None where no trigram is mandatory."""
    return _parts(P.parse(pattern))[1]


def _trigrams(query: Query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams over one block of texts."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]):
        low = [t.lower() for t in texts]
        self.n = len(texts)
        self.postings = {g: np.array([i for i, t in enumerate(low) if g in t], np.int64) for g in wanted}

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        out = self.candidates(query[1][0])
        for part in query[1][1:]:
            if query[0] == "and" and not len(out):
                break
            out = (np.intersect1d if query[0] == "and" else np.union1d)(out, self.candidates(part))
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(k, r, r.compiled(str), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        self.wanted = set().union(*(_trigrams(q) for *_, q in self.rules))
        # a full scan looks for a long enough run in the bytes first
        self.quick = {k: re.compile(rb"[0-9a-f]{%d}" % r.least) for k, r, *_ in self.rules if r.pattern == r"[0-9a-f]+"}

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule's number, end), in order; code points, end exclusive."""
        index = TrigramIndex(texts, self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        decoded: dict[int, str] = {}
        for k, rule, pattern, query in self.rules:
            for i in index.candidates(query).tolist():
                if k in self.quick and not self.quick[k].search(texts[i]):
                    continue
                if i not in decoded:
                    decoded[i] = texts[i].decode("utf-8", "surrogateescape")
                found[i] += [(m.start(), k, m.end()) for m in pattern.finditer(decoded[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(x) for x in found]


SPAN = "struct<kind:string,start:bigint,end:bigint>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans: array of kind, start, end) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in slices(batches):
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scan.spans(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    ids = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, raw(text_col)).mapInArrow(run, f"`{id_col}` {ids}, spans array<{SPAN}>")


def redact_secrets(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by [KIND]; overlapping spans become one, named after the first. Texts without
    spans, nulls and all other columns stay as they are; count_col follows the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(rules)
        for b in slices(batches):
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            new = list(texts)
            for i, spans in enumerate(scan.spans([(t or "").encode("utf-8", "surrogateescape") for t in texts])):
                if spans:
                    text, out, done = texts[i], [], 0
                    for s, k, e in spans:
                        if s >= done:
                            out += [text[done:s], f"[{rules[k].kind.upper()}]"]
                        done = max(done, e)
                    new[i] = "".join(out) + text[done:]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        out = out.withColumn(count_col, F.when(F.col(text_col).isNull(), F.col(count_col)).otherwise(F.char_length(text_col).cast(kind)))
    return out.select(*docs.columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE]

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("spans", lambda s: s.kind.isin(*kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
