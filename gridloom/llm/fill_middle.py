"""Fill-in-middle: documents cut at two unit borders and written with their middle last.

One `fullmatch` of ``(unit)*`` by the regex library keeps every repetition of its group, so ``ends(1)`` is
the list of all unit borders: its length is the number of units and two of its entries are the cuts. No loop
over units runs in Python. The units' quantifier is possessive: what a repetition took is never given back,
so a text of any length is matched in linear time.

Where the cuts fall and which form a document gets follow from a hash of its id, so runs repeat and a retried
task writes the same. `restore` gives the exact text back from an output and its form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, batches, rest, restored, texts_of

#: A line with its end, or what stands after the last end.
LINES = r"[^\n]*\n|[^\n]+"
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class FillMiddle:
    """How documents are cut and written.

    unit: a pattern that never matches the empty text and whose repetitions cover any text.
    marks: what stands before prefix, suffix and middle. None may hold another or overlap with one, itself
      included, else an output could be read in two ways; `ValueError` otherwise.
    rate, spm_rate: per cent of documents that are rearranged, and of these that begin with the suffix.
    salt: stands before the id in what is hashed.
    """

    unit: str = LINES
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    rate: int = 100
    spm_rate: int = 50
    salt: str = "7:"
    whole: regex.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        for i, a in enumerate(self.marks):
            for j, b in enumerate(self.marks):
                if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"marks {a!r} and {b!r} could be taken for each other")
        if regex.compile(self.unit).fullmatch(""):
            raise ValueError("a unit must hold at least a character")
        object.__setattr__(self, "whole", regex.compile(rf"({self.unit})*+"))

    def borders(self, text: str) -> list[int]:
        """Where the units of a text end."""
        found = self.whole.fullmatch(text)
        if found is None:
            raise ValueError("units don't cover a text")
        return found.ends(1)

    def draws(self, doc_id: int | None) -> tuple[int, int, int, int]:
        """Four numbers of 32 bits from an id; a null id is written as no digits."""
        digits = hashlib.sha256(f"{self.salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
        a, b, c, d = (int(digits[k : k + 8], 16) for k in range(0, 32, 8))
        return a, b, c, d

    def apply(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, characters of the prefix and of the middle, output)."""
        ends = self.borders(text)
        n = len(ends)
        h1, h2, h3, h4 = self.draws(doc_id)
        if not text or any(m in text for m in self.marks) or h3 % 100 >= self.rate:
            return n, "plain", None, None, text
        at = [0, *ends]
        a, b = sorted((at[h1 % (n + 1)], at[h2 % (n + 1)]))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        p, s, m = self.marks
        if h4 % 100 < self.spm_rate:
            return n, "spm", len(prefix), len(middle), f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", len(prefix), len(middle), f"{p}{prefix}{s}{suffix}{m}{middle}"

    def restore(self, output: str, form: str) -> str:
        """The text that was rearranged. `ValueError` for an output that isn't of that form."""
        if form == "plain":
            return output
        p, s, m = self.marks
        first, second = (p, s) if form == "psm" else (s, p)
        head, found1, middle = output.partition(m)
        one, found2, two = head.removeprefix(first).partition(second)
        if form not in ("psm", "spm") or not (output.startswith(first) and found1 and found2):
            raise ValueError(f"not an output of form {form}")
        return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, how: FillMiddle | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; a narrow job without a shuffle.

    Null texts are empty, and empty texts, like those that hold a mark, stay plain. Null ids share one draw, as
    do repeated ones; repeated rows give repeated rows, an empty table none, other columns don't pass.
    """
    cut = how or FillMiddle()
    unit, marks, rate, spm_rate, salt = cut.unit, cut.marks, cut.rate, cut.spm_rate, cut.salt

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = FillMiddle(unit, marks, rate, spm_rate, salt)
        for pdf in parts:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for a, b in batches(texts, 4_000_000):
                got = [(i, *mine.apply(None if i == NULL_ID else i, t)) for i, t in zip(ids[a:b], texts[a:b], strict=True)]
                out = pd.DataFrame(got, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
        rest()

    return restored(texts_of(docs, id_col, text_col).mapInPandas(run, OUT))


def restore(done: DataFrame, how: FillMiddle | None = None) -> DataFrame:
    """Adds `restored`, the text from output and form alone; null outputs give null."""
    cut = how or FillMiddle()
    unit, marks = cut.unit, cut.marks

    @F.pandas_udf("string")
    def back(output: pd.Series, form: pd.Series) -> pd.Series:
        mine = FillMiddle(unit, marks)
        return pd.Series([None if o is None or f is None else mine.restore(o, f) for o, f in zip(output, form, strict=True)], dtype=object)

    return done.withColumn("restored", back("output", "form"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  k AS (SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
  c AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
  p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
