"""Fill-in-middle transformation.

The tokenizers library's Split pre-tokenizer, with the token pattern as isolated matches, gives every token's code-point offsets
without any training. The length of a text's offset array is n; two draws from a hash of the document's id are
ranked, and the offsets at these ranks are the ends of prefix and middle. Nothing is shuffled: a document's form depends on nothing but its id and text.

A text longer than ``PART`` characters is split part by part. A part ends where a word does, before the white space after it: no token
crosses such a place, so the offsets are those of the whole text and memory stays bounded by the longest word.

Defined cases: a null text counts as empty, an empty text is plain with n 0; a null id draws as no digits; a text of white space alone is one
token; a text that holds a sentinel is plain; very long texts are cut whole; repeated rows give repeated rows; ``transform`` keeps
all other columns unless named like a new one, then the new one wins; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, prepare, table

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
WORD_END = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: Characters that the pre-tokenizer takes at once.
PART = 1 << 18


def splitter(pattern: str = TOKEN):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), "isolated")


def _parts(text: str, most: int):
    """(start, end) of the parts of a text, each ending after a word and before white space."""
    start = 0
    while len(text) - start > most:
        found = WORD_END.search(text, start + most)
        if not found:
            break
        yield start, found.start()
        start = found.start()
    yield start, len(text)


def offsets(split, text: str, most: int = PART) -> np.ndarray:
    """The ends of the tokens of a text, in code points, after a leading 0: n + 1 numbers."""
    found = [np.zeros(1, dtype=np.int64)]
    for a, b in _parts(text, most):
        if b > a:
            ends = [end for _, (_, end) in split.pre_tokenize_str(text[a:b])]
            found.append(np.array(ends, dtype=np.int64) + a)
    return np.concatenate(found)


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i: 4 * i + 4], "big") for i in range(4)]


def cut(split, doc_id, text: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT):
    """(n, form, prefix, middle, suffix) of a text; the slices are None in plain form."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends = offsets(split, text)
    n = len(ends) - 1
    if not text or h3 % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None
    a, b = (int(x) for x in ends[sorted((h1 % (n + 1), h2 % (n + 1)))])
    return n, "spm" if h4 % 100 < spm_percent else "psm", text[:a], text[a:b], text[b:]


def assemble(form: str, text: str, prefix: str | None, middle: str | None, suffix: str | None) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restore(output: str, form: str) -> str:
    """The text from which an output of a form was made."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(first):].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _rows(batch, id_index: int, text_index: int):
    """(row, id, text) of a batch, one text at a time (null: empty)."""
    ids, texts = batch.column(id_index), batch.column(text_index)
    for i in range(batch.num_rows):
        yield i, ids[i].as_py(), texts[i].as_py() or ""


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", output_col: str = "output", seed: int = SEED,
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """All columns of ``df``, with n, form, prefix_chars and middle_chars, and ``output_col``: the text in its form."""
    prepare(df.sparkSession)
    new = ["n", "form", "prefix_chars", "middle_chars", output_col]
    rest = [f for f in df.schema.fields if f.name not in new]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*rest, *(T.StructField(c, k) for c, k in zip(new, kinds))])
    key, body = fresh(df, "key", "body")
    picked = df.select(*[f.name for f in rest], F.col(id_col).alias(key), F.col(text_col).alias(body))

    def run(batches):
        split = splitter()
        for batch in batches:
            at, out, size = 0, [], 0
            for i, doc_id, text in _rows(batch, len(rest), len(rest) + 1):
                n, form, prefix, middle, suffix = cut(split, doc_id, text, seed, fim_percent, spm_percent)
                out.append((n, form, None if prefix is None else len(prefix), None if middle is None else len(middle), assemble(form, text, prefix, middle, suffix)))
                size += len(text)
                if size >= PART or i + 1 == batch.num_rows:
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k) for k in range(len(rest))), *(pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())))],
                        [*(f.name for f in rest), *new])
                    at, out, size = i + 1, [], 0

    return picked.mapInArrow(run, schema)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored") -> DataFrame:
    """``df`` with ``text_col``, the texts rebuilt from outputs and forms alone, by SQL functions."""
    o, psm = F.col(output_col), F.col(form_col) == "psm"
    first, second = F.when(psm, PREFIX).otherwise(SUFFIX), F.when(psm, SUFFIX).otherwise(PREFIX)
    one = F.call_function("substring_index", F.substr(o, F.length(first) + 1), second, F.lit(1))
    rest = F.substr(o, F.length(first) + F.length(one) + F.length(second) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(two) + len(MIDDLE) + 1)
    whole = F.when(F.col(form_col) == "plain", o).when(psm, F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return df.withColumn(text_col, whole)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): transform, rebuild from output and form, hash both."""
    prepare(df.sparkSession)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    def run(batches):
        split = splitter()
        for batch in batches:
            out = []
            for _, doc_id, text in _rows(batch, 0, 1):
                n, form, prefix, middle, suffix = cut(split, doc_id, text)
                output = assemble(form, text, prefix, middle, suffix)
                out.append((doc_id, n, form, None if prefix is None else len(prefix), None if middle is None else len(middle),
                            hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(restore(output, form).encode()).hexdigest()))
            if out:
                kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS ts, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, len(ts)::BIGINT AS n, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
    OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM t),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM f),
s AS (SELECT *, array_to_string(ts[1:a], '') AS p, array_to_string(ts[a + 1:b], '') AS m, array_to_string(ts[b + 1:n], '') AS x FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || x || '{MIDDLE}' || m
        ELSE '{SUFFIX}' || x || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(p || m || x) AS restored_sha256 FROM s
"""
