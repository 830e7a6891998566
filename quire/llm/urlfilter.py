"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are laid side by side in 64-bit words. Every rule has one bit per literal character plus a
start bit; ``*`` is a self-loop on the bit before it. One step per URL position moves all rules of all URLs
of a batch at once: ``D' = ((D << 1) & B[c]) | (D & loops)``, with carries from word to word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: (action, host and path): the longest that fits decides.
DOMAIN_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs on the whole canonical url for urls that no domain rule fits; one that fits blocks.
BLOCK_GLOBS = ("*casino*", "*cheap-pills*", "*free-money*", "*xxx*", "*poker*", "*/ads/*", "*viagra*")
#: Strings beyond LONG bytes are matched alone; the others in slices of at most SLICE bytes.
LONG, SLICE = 4096, 8 << 20
SCHEMA = "page_id long, host string, path string, rule string, verdict string, glob string"

HOST_PATH = re.compile(r"([^/?#]*)([^?#]*)", re.S)
LOWER = {i: i + 32 for i in range(65, 91)}
#: Escapes that stand for what needs none: taken back once, from left to right.
ESCAPE = re.compile(r"%(2[DdEe]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])")


class GlobSet:
    """Globs (``*`` any run, everything else literal) that must match a whole string of bytes."""

    def __init__(self, globs: tuple[str, ...]):
        self.globs = globs
        loops, begins, ends, literals, at = [], [], [], [], 0
        for g in globs:
            begins.append(at)
            for ch in g.encode():
                if ch == ord("*"):
                    loops.append(at)
                else:
                    at += 1
                    literals.append((at, ch))
            ends.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        pack = lambda bits: self._pack(bits)
        self.begin, self.loop = pack(begins), pack(loops)
        self.table = np.zeros((256, self.words), np.uint64)
        for bit, ch in literals:
            self.table[ch, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        self.ends = ends

    def _pack(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def match(self, strings: list[bytes]) -> np.ndarray:
        """Boolean (strings x globs). Strings go through together in slices of bounded size; a long one goes alone."""
        out = np.zeros((len(strings), len(self.globs)), bool)
        lengths = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-lengths, kind="stable")  # the strings still running are a prefix
        long = int((lengths > LONG).sum())
        for i in order[:long]:
            out[i] = self._match_long(strings[i])
        at = long
        while at < len(order):
            rows = max(1, SLICE // max(1, int(lengths[order[at]])))
            part = order[at : at + rows]
            out[part] = self._match_slice([strings[i] for i in part], lengths[part])
            at += rows
        return out

    def _match_slice(self, strings: list[bytes], live: np.ndarray) -> np.ndarray:
        """Of strings from the longest to the shortest."""
        n = len(strings)
        text = np.zeros((n, max(1, int(live[0]))), np.uint8)
        for row, s in enumerate(strings):
            text[row, : len(s)] = np.frombuffer(s, np.uint8)
        state = np.repeat(self.begin[None, :], n, axis=0)
        for p in range(int(live[0])):
            m = int(np.searchsorted(-live, -p, side="left"))  # rows longer than p
            d = state[:m]
            moved = d << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:m] = (moved & self.table[text[:m, p]]) | (d & self.loop)
        return np.stack([(state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) > 0 for bit in self.ends], axis=1) if self.ends else np.zeros((n, 0), bool)

    def _match_long(self, string: bytes) -> list[bool]:
        """The same steps on the words as one integer: no array of the string's length times the rows."""
        whole = lambda words: sum(int(w) << 64 * i for i, w in enumerate(words))
        state, loop, table = whole(self.begin), whole(self.loop), [whole(row) for row in self.table]
        for c in string:
            state = state << 1 & table[c] | state & loop
        return [state >> bit & 1 > 0 for bit in self.ends]


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path up to ? or #); both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = HOST_PATH.match(rest)
    return m[1].translate(LOWER), m[2]


def canonical(url: str | None) -> str:
    """What the globs see: host, path and query without the fragment, escapes of letters, digits and ``- . _ ~`` taken back, in small letters."""
    _, found, rest = (url or "").partition("://")
    plain = rest.partition("#")[0] if found else ""
    return ESCAPE.sub(lambda m: chr(int(m[1], 16)), plain).lower() if "%" in plain else plain.lower()


def judge(pages: DataFrame, rules: tuple = DOMAIN_RULES, globs: tuple[str, ...] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, the domain rule that decides (or null), the verdict, and the first glob that fits (or null).

    Map only: no shuffle, memory of one slice of urls. A null url, or one without ``://``, has empty host and
    path; no domain rule fits it and it is allowed. Repeated rows and null ids are judged one by one.
    """
    pairs = [(action, rule, *rule.partition("/")[::2]) for action, rule in rules]
    # Each domain rule is two globs over "host path": the host itself, and its subdomains. The space keeps them apart.
    domain = GlobSet(tuple(g for _, _, host, path in pairs for g in (f"{host} /{path}*", f"*.{host} /{path}*")))
    plain = GlobSet(globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (own for big in batches for own in slices(big, "url")):
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = domain.match([f"{h} {p}".encode() for h, p in parts])
            extra = plain.match([canonical(u).encode() for u in batch.column(1).to_pylist()])
            rule_out, verdicts, glob_out = [], [], []
            for i in range(len(parts)):
                host = parts[i][0]  # the exact check: a path may hold what looks like a host
                own = [k for k in range(len(pairs)) if (fits[i, 2 * k] or fits[i, 2 * k + 1]) and (host == pairs[k][2] or host.endswith(f".{pairs[k][2]}"))]
                best = max(own, key=lambda k: len(pairs[k][1]), default=None)
                hit = next((globs[k] for k in np.flatnonzero(extra[i])), None)
                rule_out.append(None if best is None else pairs[best][1])
                verdicts.append(pairs[best][0] if best is not None else "block" if hit else "allow")
                glob_out.append(hit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule_out, pa.string()), pa.array(verdicts, pa.string()), pa.array(glob_out, pa.string())],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, SCHEMA)


def judge_sql(globs: tuple[str, ...] = BLOCK_GLOBS, rules: tuple = DOMAIN_RULES) -> str:
    """The same judgement as DuckDB SQL over the view ``pages``."""
    names = "(VALUES " + ", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in rules) + ") r(action, rule, rhost, rpath)"
    hit = "CASE " + " ".join(f"WHEN whole LIKE '{g.replace('*', '%')}' THEN '{g}'" for g in globs) + " END"
    code = "(16 * (strpos('0123456789abcdef', lower(x[1])) - 1) + strpos('0123456789abcdef', lower(x[2])) - 1)"
    back = f"list_transform(string_split(split_part(rest, '#', 1), '%'), lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '^(2[DdEe]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])') THEN chr({code}::INTEGER) || x[3:] ELSE '%' || x END)"
    return f"""
    WITH u AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path, lower(array_to_string({back}, '')) AS whole, row_number() OVER () AS n
          FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)),
    f AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
          FROM h JOIN {names} ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY n)
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {hit} IS NULL THEN 'allow' ELSE 'block' END) AS verdict, {hit} AS glob
    FROM h LEFT JOIN f USING (n)
    """
