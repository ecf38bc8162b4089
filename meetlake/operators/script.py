"""Script conversion with a dictionary table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts with these are left alone: Japanese and Korean.
OTHER = r"[\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}]"

#: Up to so many entries are looked for by one pattern.
FEW = 300


def conversion(dictionary: DataFrame) -> Callable[[Column], Column]:
    """The dictionary as a function of texts: its longest entries are replaced from left to right. dictionary: key, to (of several for a key the smallest
    counts; an entry that stands for itself keeps shorter ones away). A dictionary's size doesn't follow the texts', so it is sent to the tasks; texts stay
    where they are. Few entries make one pattern; with more, each place where one may begin is looked up by its entries' lengths."""
    rows = dictionary.where("key <> ''").groupBy("key").agg(F.min("to").alias("to")).where("to is not null").collect()
    shared = dictionary.sparkSession.sparkContext.broadcast({r.key: r.to for r in rows})

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entries, lengths = shared.value, {}
        for key in entries:
            lengths.setdefault(key[0], set()).add(len(key))
        lengths = {c: sorted(n, reverse=True) for c, n in lengths.items()}
        begins = re.compile(f"[{''.join(map(re.escape, sorted(lengths)))}]").search
        if len(entries) <= FEW:
            whole = re.compile("|".join(map(re.escape, sorted(entries, key=len, reverse=True))))
            for texts in batches:
                yield texts.map(lambda text: whole.sub(lambda m: entries[m[0]], text), na_action="ignore")
            return

        def replaced(text: str | None) -> str | None:
            if text is None:
                return None
            out, done, at = [], 0, begins(text)
            while at:
                here = at.start()
                length = next((n for n in lengths[text[here]] if text[here : here + n] in entries), 0)
                if length:
                    out += (text[done:here], entries[text[here : here + length]])
                    done = here + length
                at = begins(text, here + max(length, 1))
            return "".join([*out, text[done:]])

        for texts in batches:
            yield texts.map(replaced)

    return lambda text: F.when(text.rlike(OTHER), text).otherwise(run(text)) if rows else text


def converted(texts: DataFrame, dictionary: DataFrame, key: str = "id") -> DataFrame:
    """Texts (key, text) after conversion() with the dictionary."""
    return texts.withColumn("text", conversion(dictionary)(F.col("text")))


def staged(texts: DataFrame, dictionaries: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Texts after several dictionaries, one after the other: what one has made is what the next one reads."""
    for dictionary in dictionaries:
        texts = converted(texts, dictionary, key)
    return texts


def folded(rows: DataFrame, column: str, dictionaries: Sequence[DataFrame], name: str) -> DataFrame:
    """rows with ``name``: the column's text in one script. Null stays null."""
    rows = rows.withColumn(name, F.col(column))
    for dictionary in dictionaries:
        rows = rows.withColumn(name, conversion(dictionary)(F.col(name)))
    return rows
