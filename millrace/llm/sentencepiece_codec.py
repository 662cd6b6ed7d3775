"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text is a longest path: state j at a cut says that the piece across it ends j characters
beyond. A chunk maps the states at its left cut to those at its right cut by a matrix of best scores;
matrices combine associatively by (max, +). A giant text is cut into chunks: their matrices are made in
parallel, combined by spans of chunks and then over the spans, which gives the best score of every state at every cut. From these each
chunk finds, on its own, the state at its left cut to which each state at its right one leads back; these maps too combine
associatively, which settles the states, and each chunk is traced back on its own. Texts below the limit are one chunk and need none of that.

Ids are those of the best segmentation under the file's piece scores, ties told apart alike in one chunk and in many; decoding gives every text
back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import lean, staged, unused
from millrace.llm.unigram import NEVER as UNREACHED
from millrace.llm.unigram import Pieces, byte_table, joined, pieces

CHUNK, GIANT, SPAN = 32_768, 65_536, 64
NEVER = -(1 << 62)


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; NEVER absorbs. The greatest entry becomes 0: only differences matter, and sums stay small."""
    return _level(np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER))


def _level(m: np.ndarray) -> np.ndarray:
    return np.where(m > NEVER // 2, m - m.max(), NEVER)


def _cuts(p: Pieces, text: str, size: int, width: int) -> tuple[int, int, list[str]] | None:
    """First and last place in a chunk that no piece crosses, and the spans between them."""
    at, first, last, spans = 0, None, None, []
    for m in p.span.finditer(text):
        if m.start() >= width and first is None:
            first = m.start()
        if m.start() > size:
            break
        at = m.start()
        if first is not None:
            last = at
            spans.append(m[0])
    if first is None or first > size or last is None or last <= first:
        return None
    return first, last, spans[:-1]


def transfer(p: Pieces, text: str, size: int) -> np.ndarray:
    """Best scores from each state at a chunk's start to each at its end; text holds the chunk's size characters and what may follow."""
    width = p.longest
    out = np.full((width, width), NEVER, np.int64)
    cut = None if p.crossing else _cuts(p, text, size, width)

    def fill(row: int, best: list[int], base: int, offset: int) -> None:
        for j in range(min(width, len(best) - (size - offset))):
            s = best[size - offset + j]
            if s != UNREACHED:
                out[row, j] = s + base

    if cut:
        first, last, spans = cut
        middle = sum(p.best(s)[0] for s in spans)
        tail = p.forward(text[last:], {0: 0}, size - last)[0]
        for i in range(min(width, len(text) + 1)):
            head = p.forward(text[:first], {i: 0}, first)[0][first]
            if head != UNREACHED:
                fill(i, tail, head + middle, last)
    else:
        for i in range(min(width, len(text) + 1)):
            fill(i, p.forward(text, {i: 0}, size)[0], 0, 0)
    return out


def _starts(row: np.ndarray) -> dict[int, int]:
    return {int(i): int(row[i]) for i in np.flatnonzero(row > NEVER // 2)}


def _traced_back(p: Pieces, text: str, size: int, row: np.ndarray):
    """back(end): where the best path to a state at the right cut begins, None for a state no path reaches; ids(end): its ids."""
    cut = None if p.crossing else _cuts(p, text, size, p.longest)
    starts = _starts(row)
    first, last, spans = cut if cut else (size, 0, [])
    best, piece, back = p.forward(text[:first] if cut else text, starts, first)

    def begin(back: list[int], at: int) -> int:
        while back[at] >= 0:
            at = back[at]
        return at

    if not cut:
        reach = lambda end: begin(back, size + end) if size + end < len(best) and best[size + end] != UNREACHED else None
        return reach, lambda end: np.array(p.walk(text, piece, back, size + end, reach(end)), np.int32)
    start = begin(back, first)
    tail_best, tail_piece, tail_back = p.forward(text[last:], {0: 0}, size - last)
    reach = lambda end: start if size - last + end < len(tail_best) and tail_best[size - last + end] != UNREACHED else None

    def ids(end: int) -> np.ndarray:
        head, tail = p.walk(text[:first], piece, back, first, start), p.walk(text[last:], tail_piece, tail_back, size + end - last, 0)
        return np.concatenate([np.array(head, np.int32), np.frombuffer(b"".join(p.best(s)[1] for s in spans), np.int32), np.array(tail, np.int32)])

    return reach, ids


def leads_back(p: Pieces, text: str, size: int, row: np.ndarray) -> np.ndarray:
    """For each state at a chunk's end the state at its start that the best path comes from, by the best scores of states there; -1 where there is none."""
    reach, _ = _traced_back(p, text, size, row)
    return np.array([-1 if (s := reach(j)) is None else s for j in range(p.longest)], np.int32)


def traced(p: Pieces, text: str, size: int, row: np.ndarray, end: int) -> np.ndarray:
    """Ids of the best path through a chunk to a state at its end."""
    return _traced_back(p, text, size, row)[1](end)


def chunks(text: str, size: int, width: int) -> Iterator[tuple[int, str, int]]:
    """(k, text of the chunk and the width characters after it, its size); the leading space is added here."""
    text = " " + text
    for k, at in enumerate(range(0, len(text), size)):
        yield k, text[at : at + size + width], min(size, len(text) - at)


def first_row(width: int) -> np.ndarray:
    """Before a text only the state without a piece across is there."""
    row = np.full(width, NEVER, np.int64)
    row[0] = 0
    return row


def scan(matrices: list[np.ndarray], row: np.ndarray) -> list[np.ndarray]:
    """Best scores of the states at all cuts of a row of chunks, the first of them given; one less than there are cuts, as the last needs none."""
    rows = [row]
    for m in matrices[:-1]:
        rows.append(_level(np.maximum((rows[-1][:, None] + m).max(axis=0), NEVER)))
    return rows


def _ids(path: str, text: int, merges: bool = False, batch_chars: int = 2_000_000):
    """Adds a column of ids; text is the place of the text's column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            at, texts, names = 0, batch.column(text), [*batch.schema.names, "\0ids"]
            while at < len(texts):  # so many characters at a time
                some, size, begun = [], 0, at
                while at < len(texts) and size < batch_chars:
                    some.append(texts[at].as_py() or "")
                    size += len(some[-1])
                    at += 1
                ids = p.merged_all(some) if merges else p.encode_all(some)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                part = batch.slice(begun, at - begun)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names)

    return run


def _cut_up(size: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, text in zip(pdf["sha"], pdf["text"], strict=True):
                for k, piece, n in chunks(text, size, width):
                    yield pd.DataFrame({"sha": [key], "k": [k], "text": [piece], "size": [n]})

    return run


def _matrices(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for pdf in batches:
            yield pd.DataFrame({"sha": pdf["sha"], "k": pdf["k"], "m": [transfer(p, t, n).tobytes() for t, n in zip(pdf["text"], pdf["size"], strict=True)]})

    return run


def _load(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw, np.int64)
    return m.reshape(int(len(m) ** 0.5), -1)


def _span_product(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("k")
    m = _load(pdf["m"].iat[0])
    for raw in pdf["m"].iloc[1:]:
        m = combined(m, _load(raw))
    return pd.DataFrame({"sha": [pdf["sha"].iat[0]], "span": [pdf["span"].iat[0]], "m": [m.tobytes()]})


def _frame(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
    return pd.DataFrame({"sha": pdf["sha"], **columns})


def _span_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best scores at the start of every span of chunks of a text."""
    pdf = pdf.sort_values("span")
    matrices = [_load(x) for x in pdf["m"]]
    return _frame(pdf, span=pdf["span"], row=[r.tobytes() for r in scan(matrices, first_row(len(matrices[0])))])


def _chunk_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same at the start of every chunk of a span."""
    pdf = pdf.sort_values("k")
    return _frame(pdf, k=pdf["k"], row=[r.tobytes() for r in scan([_load(x) for x in pdf["m"]], np.frombuffer(pdf["row"].iat[0], np.int64))])


def _maps(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for pdf in batches:
            made = [leads_back(p, t, n, np.frombuffer(row, np.int64)).tobytes() for t, n, row in zip(pdf["text"], pdf["size"], pdf["row"], strict=True)]
            yield _frame(pdf, k=pdf["k"], row=pdf["row"], back=made)

    return run


def _span_map(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where each state at the end of a span leads back to at its start."""
    found = None
    for raw in pdf.sort_values("k", ascending=False)["back"]:
        back = np.frombuffer(raw, np.int32)
        found = back if found is None else np.where(found >= 0, back[np.maximum(found, 0)], -1)
    return pd.DataFrame({"sha": [pdf["sha"].iat[0]], "span": [pdf["span"].iat[0]], "back": [found.astype(np.int32).tobytes()]})


def _ends(by: str, first: str | None):
    """The state at the end of every span of a text, or every chunk of a span, from the one at the end of all (first: its column; 0 without)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, ascending=False)
        end, ends = int(pdf[first].iat[0]) if first else 0, []
        for raw in pdf["back"]:
            ends.append(end)
            end = int(np.frombuffer(raw, np.int32)[end])
        return _frame(pdf, **{by: pdf[by], "last": ends})

    return run


def _trace(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for pdf in batches:
            ids = [traced(p, t, n, np.frombuffer(row, np.int64), b) for t, n, row, b in zip(pdf["text"], pdf["size"], pdf["row"], pdf["last"], strict=True)]
            yield _frame(pdf, k=pdf["k"], ids=ids)

    return run


def giant_ids(texts: DataFrame, model: str, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(sha, ids) for texts (sha, text), not empty, by the scan; rows that repeat a sha are one text. Other columns are not read; no rows give none."""
    width = pieces(model).longest
    if chunk <= 2 * width:
        raise ValueError("a chunk must be longer than two of the longest pieces")
    by = ["sha", "span"]
    spanned = F.floor(F.col("k") / span)
    cut = staged(texts.mapInPandas(_cut_up(chunk, width), "sha string, k long, text string, size int").dropDuplicates(["sha", "k"]), "chunks")
    made = staged(cut.mapInPandas(_matrices(model), "sha string, k long, m binary").withColumn("span", spanned), "matrices")
    edges = made.groupBy(*by).applyInPandas(_span_product, "sha string, span long, m binary").groupBy("sha").applyInPandas(_span_rows, "sha string, span long, row binary")
    rows = made.join(edges, by).groupBy(*by).applyInPandas(_chunk_rows, "sha string, k long, row binary")
    maps = staged(cut.join(rows, ["sha", "k"]).mapInPandas(_maps(model), "sha string, k long, row binary, back binary").withColumn("span", spanned), "maps")
    ends = maps.groupBy(*by).applyInPandas(_span_map, "sha string, span long, back binary").groupBy("sha").applyInPandas(_ends("span", None), "sha string, span long, last int")
    ends = maps.join(ends, by).groupBy(*by).applyInPandas(_ends("k", "last"), "sha string, k long, last int")
    ids = cut.join(maps.select("sha", "k", "row"), ["sha", "k"]).join(ends, ["sha", "k"]).mapInPandas(_trace(model), "sha string, k long, ids array<int>")
    return ids.groupBy("sha").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK, giant: int = GIANT, merges: bool = False) -> DataFrame:
    """docs with ids_col (array<int>) at their end; a column of that name in docs is replaced.

    Null and empty texts give an empty array. Repeated texts, rows and ids are encoded alike; an empty table stays empty.
    Other columns pass through untouched, whatever their names. merges: the ids that the file's own kind of model gives (those its owner gets from a
    BPE file), each text in one piece; such a model may fold or drop characters, so decoding need not give the text back.
    """
    kept = [c for c in docs.columns if c != ids_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    long = F.coalesce(F.length(text_col) > giant, F.lit(False)) if not merges else F.lit(False)
    own, key, scanned = unused(docs, "ids", "key", "scanned")
    schema = T.StructType([*docs.schema.fields, T.StructField(own, T.ArrayType(T.IntegerType()))])
    # the column's own name may be taken inside, so it gets its name outside
    short = docs.where(~long).mapInArrow(lean(_ids(model, kept.index(text_col), merges), pieces.cache_clear), schema).toDF(*kept, ids_col)
    some = docs.where(long).withColumn(key, F.sha2(F.col(text_col), 256))
    if merges or not some.take(1):
        return short
    by_scan = giant_ids(some.select(F.col(key).alias("sha"), F.col(text_col).alias("text")), model, chunk).toDF(scanned, own)
    return short.unionByName(some.join(by_scan, F.col(key) == F.col(scanned)).select(*[F.col(f"`{c}`") for c in kept], F.col(own).alias(ids_col)))


def decode(docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of their ids; null ids give null, none an empty text. Repeated rows are decoded each; an empty table stays empty; a column of the text's name is replaced."""

    @F.arrow_udf(T.StringType())
    def texts(ids: pa.Array) -> pa.Array:
        table = byte_table(model)

        def some(part: pa.Array) -> pa.Array:
            """UTF-8 of a few rows, without Python texts."""
            flat, lengths = part.flatten().to_numpy(zero_copy_only=False), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths, dtype=np.int64)
            raw = [joined(table, flat[b - n : b].tolist()) if v else None for b, n, v in zip(ends, lengths, part.is_valid().to_pylist(), strict=True)]
            return pa.array(raw, pa.binary()).cast(pa.string())

        return pa.concat_arrays([some(ids.slice(i, 500)) for i in range(0, len(ids), 500)] or [pa.array([], pa.string())])

    return docs.withColumn(text_col, texts(F.col(ids_col)))
