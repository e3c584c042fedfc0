"""Fill-in-middle transformation by an event scan.

A text is cut into units, runs of ASCII letters and single other characters, and
rebuilt as prefix, suffix and middle around two unit counts. Units are never
listed. The text is folded so that every character that is neither a letter nor
an angle bracket is a blank, and one Aho-Corasick automaton finds runs of blanks
(patterns of doubling length, so a run takes few events), brackets and
sentinels: the characters that change the class. What lies between two events is
letters only, hence one unit; an event has as many units as characters. Running
sums over the events then give the number of units and, by binary search, the
character at which any unit ends.

Texts are scanned in blocks that end after a blank, so neither a run of letters
nor a sentinel is cut and the events held at once stay bounded; a second scan
reads only the blocks that hold the two ends.

Defined cases: null text counts as empty, and an empty text stays plain, as does
one that contains a sentinel; a null id is hashed as empty text; rows with equal
id and text get equal results; an empty table gives an empty result. All columns
of the caller pass through; a column with the name of the result is replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracelake.llm.common import LOWER, UPPER, small_batches, table, thin, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are left plain, and of a hundred others so many have the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
BLOCK, SLICE = 1 << 20, 4 << 20
KEPT = frozenset((UPPER + LOWER + "<>").encode())
FOLD = bytes(c if c in KEPT else 32 for c in range(256))
RESULT = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Its values are the lengths of what was found, negative for sentinels."""
    found = ahocorasick.Automaton()
    for run in [" " * 2**j for j in range(11)] + ["<", ">"]:
        found.add_word(run, len(run))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(mark, -len(mark))
    found.make_automaton()
    return found


class Events:
    """The class-changing events of a piece of folded text, and what they say about its units."""

    def __init__(self, piece: str):
        found = np.fromiter(chain.from_iterable(automaton().iter_long(piece)), np.int64).reshape(-1, 2)
        end, size = found[:, 0] + 1, np.abs(found[:, 1])
        self.length, self.start = len(piece), end - size
        #: One where letters lie before an event.
        self.gap = (self.start > np.append(0, end[:-1])).astype(np.int64) if len(end) else end
        self.total = np.cumsum(size + self.gap)
        self.marked = bool((found[:, 1] < 0).any())
        self.units = (int(self.total[-1]) if len(end) else 0) + int(self.length > (int(end[-1]) if len(end) else 0))

    def place(self, k: int) -> int:
        """How many characters the first k units have."""
        if k <= 0:
            return 0
        i = int(np.searchsorted(self.total, k))
        if i == len(self.total):
            return self.length
        before = int(self.total[i - 1]) if i else 0
        return int(self.start[i]) + k - before - int(self.gap[i])


def pieces(folded: str) -> Iterator[tuple[int, int]]:
    """(from, to) of blocks of some BLOCK characters, each but the last ending after a blank."""
    at = 0
    while at < len(folded):
        end = folded.find(" ", at + BLOCK - 1) + 1 if at + BLOCK < len(folded) else 0
        yield at, end or len(folded)
        at = end or len(folded)


class Units:
    """Number and places of the units of a text."""

    def __init__(self, text: str):
        # Each code point outside ASCII becomes one question mark, so places are those of the text.
        self.folded = text.encode("ascii", "replace").translate(FOLD).decode("ascii")
        self.cuts, self.ends, self.n, self.marked = list(pieces(self.folded)), [], 0, False
        for cut in self.cuts:
            self.last = (cut, Events(self.folded[slice(*cut)]))
            self.n += self.last[1].units
            self.marked |= self.last[1].marked
            self.ends.append(self.n)

    def place(self, k: int) -> int:
        if k <= 0:
            return 0
        i = bisect_left(self.ends, k)
        cut = self.cuts[i]
        if self.last[0] != cut:
            self.last = (cut, Events(self.folded[slice(*cut)]))
        return cut[0] + self.last[1].place(k - (self.ends[i - 1] if i else 0))


def chosen(key: str, doc_id: str) -> list[int]:
    """The four numbers that decide about a document."""
    digest = hashlib.sha256(f"{key}:{doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(text: str, draws: list[int]) -> dict:
    units = Units(text)
    first, second, plain, order = draws
    row = {"n": units.n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    if not text or units.marked or plain % 100 >= PLAIN_FROM:
        return row
    ends = sorted((first % (units.n + 1), second % (units.n + 1)))
    a, b = map(units.place, ends)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    spm = order % 100 < SUFFIX_FIRST
    parts = (SUFFIX, suffix, PREFIX, prefix) if spm else (PREFIX, prefix, SUFFIX, suffix)
    return row | {"form": "spm" if spm else "psm", "prefix_chars": a, "middle_chars": b - a, "output": "".join((*parts, MIDDLE, middle))}


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", result: str = "fim", key: str = "1") -> DataFrame:
    """docs with a struct column of n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    key changes all random choices; the same key, id and text give the same result.
    """
    kept = docs.drop(result)
    schema = T.StructType([*kept.schema.fields, T.StructField(result, T.StructType.fromDDL(RESULT[7:-1]))])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema).field(result).type
        for whole in batches:
            for batch in thin(whole, SLICE):
                own, ids = batch.columns[:-1], batch.columns[-1].to_pylist()
                rows = [transformed(t or "", chosen(key, i)) for t, i in zip(own[at].to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(rows, kind)], names=schema.names)

    small_batches(docs.sparkSession)
    named = kept.select("*", F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__id_as_text"))
    return named.mapInArrow(tidy(run), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: sentinels occur in it only where they were put."""
    place = lambda mark: F.instr(output, mark)
    cut = lambda a, b: F.substring(output, a + 3, b - a - 3)
    p, s, m = place(PREFIX), place(SUFFIX), place(MIDDLE)
    end = F.length(output) + 1
    psm = F.concat(cut(p, s), cut(m, end), cut(s, m))
    spm = F.concat(cut(p, m), cut(m, end), cut(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


OP11_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
drawn AS (
  SELECT *, len(unit) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut
),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (SELECT *, array_to_string(unit[1:a], '') AS p, array_to_string(unit[a + 1:b], '') AS m, array_to_string(unit[b + 1:], '') AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's fill-in-middle form."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c, 256)
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(text).alias("restored_sha256"))
