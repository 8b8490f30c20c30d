"""Text conversion by a table of phrases, the longest match first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PhraseTrie:
    """Phrases by their characters; a node is a dict, with the replacement under None."""

    def __init__(self, table: dict[str, str]):
        self.root: dict = {}
        for phrase, replacement in table.items():
            node = self.root
            for c in phrase:
                node = node.setdefault(c, {})
            if phrase:
                node[None] = replacement

    def convert(self, text: str) -> str:
        """From the left, the longest phrase at each place is replaced; other characters stay."""
        out, at, end = [], 0, len(text)
        while at < end:
            node, k, found, until = self.root, at, text[at], at + 1
            while k < end and (node := node.get(text[k])) is not None:
                k += 1
                if None in node:
                    found, until = node[None], k
            out.append(found)
            at = until
        return "".join(out)


def converted(text: Column, table: dict[str, str]) -> Column:
    """``text`` with the phrases of a table replaced, such as traditional by simplified characters; null stays null, an empty table changes nothing.

    The table is part of the plan and goes to every worker: thousands of
    phrases, not data that grows.
    """

    @F.pandas_udf(T.StringType())
    def convert(texts: pd.Series) -> pd.Series:
        trie = PhraseTrie(table)
        return texts.map(lambda t: None if t is None else trie.convert(t))

    return convert(text) if table else text


def phrase_table(rows: DataFrame, phrase: str, replacement: str, most: int = 200_000) -> dict[str, str]:
    """A table of phrases as ``converted`` takes it; with more than ``most`` rows it is an error. Of equal phrases the smallest replacement counts."""
    found = rows.where(F.col(phrase).isNotNull()).groupBy(phrase).agg(F.min(replacement).alias("r")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} phrases")
    return {r[phrase]: r["r"] or "" for r in found}
