"""Fill-in-middle: texts cut at unit boundaries and their pieces put in another order.

A unit is a run of ASCII letters or any one other character. Every text is divided
into fixed blocks of its UTF-8 bytes, and a Fenwick tree stores for each block the
number of units and of code points that begin in it. A cut after k units is found by
binary lifting: the descent adds halving strides of blocks as long as fewer than
k + 1 units begin before them, which gives the block and, from the same sums, the
code points before it. Only that block is then looked at for the boundary. Counting
goes over a text in bounded stretches, so a long text needs no arrays of its length.

Tasks give the numbers alone; Spark's functions put the texts together and take them
apart again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES, STRETCH_BYTES = 1024, 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Fenwick:
    """Prefix sums of pairs (units, code points) over the blocks of one text."""

    def __init__(self, counts: np.ndarray):
        self.n = len(counts)
        self.tree = np.zeros((self.n + 1, 2), dtype=np.int64)
        self.tree[1:] = counts
        step = 1
        while step <= self.n:
            # nodes at odd multiples of the step hand their sums to the next node up
            child = np.arange(step, self.n + 1, 2 * step)
            child = child[child + step <= self.n]
            self.tree[child + step] += self.tree[child]
            step *= 2

    def descend(self, units: int) -> tuple[int, int, int]:
        """(block, units, code points): the last block with at most ``units`` units before it, and both sums before it."""
        block, total = 0, np.zeros(2, dtype=np.int64)
        step = 1 << self.n.bit_length()
        while step:
            if block + step <= self.n and total[0] + self.tree[block + step][0] <= units:
                block += step
                total = total + self.tree[block]
            step >>= 1
        return block, int(total[0]), int(total[1])


def starts_of(data: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a unit, and whether a code point, begins at each byte; ``before`` is the byte ahead or -1."""
    letter = _LETTER[data]
    point = (data & 0xC0) != 0x80
    follows = np.empty(len(data), dtype=bool)
    follows[:1] = before >= 0 and _LETTER[before]
    follows[1:] = letter[:-1]
    return point & ~(letter & follows), point


def block_counts(data: np.ndarray, offsets: np.ndarray, block_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, code points) of every block of the texts, and each text's first block."""
    n_blocks = -(-np.diff(offsets) // block_bytes)
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    counts = np.zeros((first[-1], 2), dtype=np.int64)
    if not len(counts):
        return counts, first
    owner = np.repeat(np.arange(len(n_blocks)), n_blocks)
    begins = offsets[owner] + (np.arange(len(owner)) - first[owner]) * block_bytes
    ends = np.append(begins[1:], offsets[-1])
    heads = np.unique(offsets[:-1][n_blocks > 0])
    at = 0
    while at < len(begins):
        # a stretch of whole blocks
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + STRETCH_BYTES, side="right")))
        lo, hi = int(begins[at]), int(ends[to - 1])
        unit, point = starts_of(data[lo:hi], int(data[lo - 1]) if lo else -1)
        # a text's first byte begins a unit whatever stands before it
        own = heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)]
        unit[own - lo] = True
        where = begins[at:to] - lo
        counts[at:to, 0] = np.add.reduceat(unit.astype(np.int64), where)
        counts[at:to, 1] = np.add.reduceat(point.astype(np.int64), where)
        at = to
    return counts, first


def cut_at(data: np.ndarray, tree: Fenwick, units: int, block_bytes: int) -> int:
    """Code points before the boundary after the first ``units`` units of one text."""
    block, units_before, points_before = tree.descend(units)
    if block >= tree.n:
        return points_before
    lo = block * block_bytes
    unit, point = starts_of(data[lo : lo + block_bytes], int(data[lo - 1]) if lo else -1)
    place = int(np.flatnonzero(unit)[units - units_before])
    return points_before + int(np.count_nonzero(point[:place]))


def _cuts(batch_text, one, two, block_bytes: int) -> np.ndarray:
    """Rows of (units, code points of the prefix, of the middle) for an Arrow column of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(batch_text.cast(pa.large_string()), "")
    n = len(column)
    out = np.zeros((n, 3), dtype=np.int64)
    if not n:
        return out
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    counts, first = block_counts(data, offsets, block_bytes)
    for k in range(n):
        mine = counts[first[k] : first[k + 1]]
        units = int(mine[:, 0].sum())
        tree, text = Fenwick(mine), data[offsets[k] : offsets[k + 1]]
        low, high = sorted((int(one[k]) % (units + 1), int(two[k]) % (units + 1)))
        prefix = cut_at(text, tree, low, block_bytes)
        out[k] = units, prefix, cut_at(text, tree, high, block_bytes) - prefix
    return out


def cuts(text: Column, one: Column, two: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    """struct<n, prefix_chars, middle_chars>: units, and code points of the two first pieces.

    With n units the prefix ends after the smaller of ``one % (n + 1)`` and
    ``two % (n + 1)`` units, the middle after the larger. A null text is empty; the
    numbers must not be null or below nought.
    """

    @F.arrow_udf("struct<n: long, prefix_chars: long, middle_chars: long>")
    def found(texts, a, b):
        import pyarrow as pa

        rows = _cuts(texts, a.to_numpy(), b.to_numpy(), block_bytes)
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["n", "prefix_chars", "middle_chars"])

    return found(text, one.cast("long"), two.cast("long"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, n, form, prefix_chars, middle_chars, output.

    ``output`` is the text (form ``plain``), prefix, suffix and middle behind their
    marks (``psm``), or suffix, prefix and middle (``spm``). Cuts and forms follow from
    the SHA-256 of ``seed:id``, so reruns agree; a null id counts as an empty one, and
    rows that repeat an id are each cut by their own text. Null texts are empty. Empty
    texts and texts that hold a mark stay plain, so ``restored`` can take every output
    apart. Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *(x.alias(f"_h{k + 1}") for k, x in enumerate(h)))
    found = rows.withColumn("_c", cuts(F.col("_text"), F.col("_h1"), F.col("_h2"), block_bytes))
    text, a, b = F.col("_text"), F.col("_c.prefix_chars").cast("int"), F.col("_c.middle_chars").cast("int")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (F.col("_h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    told = found.withColumn("form", form)
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b), F.substring(text, a + b + 1, F.char_length(text))
    put = lambda *parts: F.concat(*(x for mark, piece in parts for x in (F.lit(mark), piece)))
    psm = put((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle))
    spm = put((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle))
    cut = F.col("form") != "plain"
    return told.select(
        F.col("_id").alias(id_col),
        F.col("_c.n").alias("n"),
        "form",
        F.when(cut, F.col("_c.prefix_chars")).alias("prefix_chars"),
        F.when(cut, F.col("_c.middle_chars")).alias("middle_chars"),
        F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone.

    Pieces hold no mark, and no piece's end can make one with what follows, so each mark
    stands in the output once.
    """

    def between(first: str, then: str | None) -> Column:
        rest = F.substring_index(output, first, -1)
        return rest if then is None else F.substring_index(rest, then, 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


#: DuckDB's form of the registered query.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
             [CAST('0x' || substr(h, k, 8) AS BIGINT) for k in [1, 9, 17, 25]] AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
