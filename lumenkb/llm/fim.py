"""Operator 13: the fill-in-middle transformation, cut by rank and select over the bytes of texts.

A task takes texts as they lie in an Arrow batch: one buffer of UTF-8 bytes. A bitvector marks the bytes that begin a
code point. The ones in a text are its length n; a cut after k code points is at the byte of the one that has k more
before it than the text's first. No text is decoded, and nothing is looked at character by character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenkb.llm.bits import Bits
from lumenkb.session import ship_code

#: What stands before prefix, suffix and middle.
MARKS = ["<P>", "<S>", "<M>"]
#: Bytes of texts that one bitvector covers, unless a single text is longer.
SPAN = 1 << 23


def cut(text: pa.StringArray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n of each text, its two cuts in code points (smaller first), and the places of start, cuts and end in the array's buffer.

    The cuts are after first % (n + 1) and second % (n + 1) code points.
    """
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    n, cuts, places = np.zeros(len(text), np.int64), np.zeros((len(text), 2), np.int64), np.zeros((len(text), 4), np.int64)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SPAN, "right")) - 1)
        at = offsets[lo : hi + 1]
        bits = Bits((data[at[0] : at[-1]] & 0xC0) != 0x80)
        ranks = bits.rank(at - at[0])
        n[lo:hi] = size = np.diff(ranks)
        cuts[lo:hi] = np.sort(np.stack([first[lo:hi] % (size + 1), second[lo:hi] % (size + 1)], axis=1), axis=1)
        places[lo:hi, 0], places[lo:hi, 3] = at[:-1], at[1:]
        for j in (0, 1):  # a cut at a text's end is where the next one begins
            places[lo:hi, j + 1] = at[0] + bits.select(ranks[:-1] + cuts[lo:hi, j])
        lo = hi
    return n, cuts, places


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in MARKS)
    for batch in batches:
        doc, text, first, second, form = batch.columns
        n, cuts, places = cut(text, first.to_numpy(), second.to_numpy())
        raw, forms, out = memoryview(text.buffers()[2] or b""), form.to_pylist(), []
        for f, (a, b, c, d) in zip(forms, places.tolist(), strict=True):
            prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:d]
            out.append(b"".join({"plain": (prefix, middle, suffix), "psm": (p, prefix, s, suffix, m, middle), "spm": (s, suffix, p, prefix, m, middle)}[f]))
        whole = np.array([f == "plain" for f in forms], bool)
        chars = [pa.array(x, mask=whole) for x in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
        yield pa.RecordBatch.from_arrays([doc, pa.array(n), form, *chars, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    ``docs``: doc_id, text; other columns are ignored. Four numbers from the sha256 of the seed, a colon and the id
    choose both cuts, whether a text is transformed (``rate`` of a hundred) and in which order (``spm_rate`` of a
    hundred with the suffix first). A text that is empty, null (which is empty) or holds one of MARKS stays plain. A
    null doc_id counts as no digits. Rows are transformed each on its own, so rows that repeat give the same again, ties
    don't occur and an empty table gives no rows. A text takes the memory of its bytes several times over in a task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = text.contains(MARKS[0]) | text.contains(MARKS[1]) | text.contains(MARKS[2])
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("_h"))
    rows = rows.select("doc_id", text.alias("text"), h[0].alias("first"), h[1].alias("second"), form.alias("form"))
    return rows.mapInArrow(_transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    part = lambda i: F.element_at(F.split(output, f"<[{''.join(x[1] for x in MARKS)}]>", -1), i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))
