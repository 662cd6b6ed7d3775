"""Token counts by dynamic programming over a shared trie.

Tokens are those of the best segmentation under a SentencePiece file's piece scores. The distinct pre-tokens of a batch are
inserted in a trie, in sorted order, so that it is walked once: a node holds the best score and count of its prefix and the pieces still
open there, computed once for all pre-tokens that share it. Terminal nodes give a pre-token's count, and a
document's count is the sum over its pre-tokens. Each task works on its own documents: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.unigram import NEVER, Pieces, pieces

#: Characters of text whose pre-tokens share a trie, and counts that are remembered from one trie to the next.
BATCH, ROOM = 4_000_000, 400_000


def terminal_counts(p: Pieces, words: list[str]) -> dict[str, int]:
    """Tokens of each of the words, which must be sorted."""
    root, single, unknown = p.root, p.single, p.unknown
    # the path of trie nodes from the root to the last word's end: (score, tokens, open pieces)
    path: list[tuple[int, int, list]] = [(0, 0, [])]
    out: dict[str, int] = {}
    last = ""
    for word in words:
        shared = 0
        for a, b in zip(last, word, strict=False):
            if a != b:
                break
            shared += 1
        del path[shared + 1 :]
        for c in word[shared:]:
            score, tokens, live = path[-1]
            best, count = NEVER, 0
            if c not in single:
                best, count = score + unknown, tokens + len(c.encode("utf-8", "replace"))
            still = []
            # open pieces, the longest first; the one that begins here is the last
            for s, t, node in live:
                if (node := node.get(c)) is not None:
                    still.append((s, t, node))
                    if (end := node.get(0)) and s + end[0] > best:
                        best, count = s + end[0], t + 1
            if (node := root.get(c)) is not None:
                still.append((score, tokens, node))
                if (end := node.get(0)) and score + end[0] > best:
                    best, count = score + end[0], tokens + 1
            path.append((best, count, still))
        out[word] = path[-1][1]
        last = word
    return out


def _counted(model: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, known = pieces(model), {}
        for pdf in batches:
            tokens, words = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            at = 0
            texts = pdf["text"].tolist()
            while at < len(texts):
                spans, size, begun = [], 0, at
                while at < len(texts) and size < BATCH:
                    text = texts[at] or ""
                    spans.append(p.span.findall(" " + text) if text else [])
                    size += len(text)
                    at += 1
                fresh = {s for doc in spans for s in doc if s not in known}
                if len(known) + len(fresh) > ROOM:
                    known = {}
                    fresh = {s for doc in spans for s in doc}
                known.update(terminal_counts(p, sorted(fresh)))
                get = known.__getitem__
                tokens[begun:at] = [sum(map(get, doc)) for doc in spans]
                words[begun:at] = [len(doc) for doc in spans]
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": tokens, "n_pretokens": words})

    return run


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_pretokens.

    Null and empty texts have none of either. Repeated rows and ids are counted each; a null id stays null. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_counted(model), "id long, n_tokens long, n_pretokens long").withColumnRenamed("id", id_col)
