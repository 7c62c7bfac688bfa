"""Language of a text by unigrams over a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxworks.llm import textbytes as tb
from waxworks.llm.registry import query

#: Rows of a language that its probabilities are fitted on: those with the smallest hash of their key.
SAMPLE_ROWS = 1000
ROUNDS, SMOOTHING, BYTE_SHARE = 3, 0.05, 1e-4
UNKNOWN = "und"
_SLICE = 2 << 20
_WORDS = 50_000  # words of a forward pass; bounds memory only
_AREA = 16 * _WORDS  # cells of a chunk of words; what is held of one takes about 100 bytes a cell when fitting
_CELLS = 250_000  # positions of words whose pieces are looked up at once when fitting; bounds memory only


class Pieces:
    """The fixed vocabulary, by hash of a piece's bytes. The word boundary is a space at the start of a piece.

    Every single byte is a piece too, so that any text has a segmentation.
    """

    def __init__(self, pieces: list[str]):
        texts = dict.fromkeys(p.replace("▁", " ").encode() for p in pieces)
        longer = [t for t in texts if len(t) > 1]
        self.texts = [bytes([b]) for b in range(256)] + longer
        self.size, self.longest = len(self.texts), max(map(len, self.texts))
        flat = np.frombuffer(b"".join(self.texts), np.uint8)
        ends = np.cumsum([len(t) for t in self.texts])
        hashes = _plain(flat, np.concatenate([[0], ends[:-1]]), ends)
        self.tables, left = [], np.arange(self.size)
        shift = 64
        while len(left):  # what finds its place taken goes to the next table, under other bits
            shift -= 18
            at = ((hashes[left] >> np.uint64(shift)) & np.uint64((1 << 18) - 1)).astype(np.int64)
            table = np.full(1 << 18, -1, np.int32)
            table[at[::-1]] = left[::-1]
            self.tables.append((np.uint64(shift), table))
            left = left[table[at] != left]
        self.hashes = hashes

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        for shift, table in self.tables:
            got = table[((hashes >> shift) & np.uint64((1 << 18) - 1)).astype(np.int64)]
            same = (got >= 0) & (self.hashes[got] == hashes)
            out[same] = got[same]
        return out


def _plain(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = tb.scales(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(tb.BYTE[buf] * up[:-1], out=sums[1:])
    return tb.mix((sums[ends] - sums[starts]) * down[starts])


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows, longest first, each after a space."""
    sizes = np.array([len(w) + 1 for w in words])
    width = int(sizes.max())
    flat = np.frombuffer(b"".join(b" " + w.ljust(width - 1, b"\0") for w in words), np.uint8)
    return flat.reshape(len(words), width), sizes


def _edges(pieces: Pieces, words: list[bytes]):
    """For each end position the pieces that end there: (end, length, rows, piece ids). Words are longest first."""
    matrix, sizes = _matrix(words)
    up, down = tb.scales(matrix.shape[1] + 1)
    sums = np.zeros((len(words), matrix.shape[1] + 1), np.uint64)
    np.cumsum(tb.BYTE[matrix] * up[:-1], axis=1, out=sums[:, 1:])
    sums = np.ascontiguousarray(sums.T)
    alive = np.searchsorted(-sizes, -np.arange(1, matrix.shape[1] + 1), "right")
    for end in range(1, matrix.shape[1] + 1):
        n = alive[end - 1]
        for length in range(1, min(end, pieces.longest) + 1):
            ids = pieces.find(tb.mix((sums[end, :n] - sums[end - length, :n]) * down[end - length]))
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                yield end, length, rows, ids[rows]


def _chunks(words: list[bytes]) -> Iterator[np.ndarray]:
    """Index arrays, longest words first, of bounded area."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        rows = max(1, min(_WORDS, (_AREA) // (int(sizes[order[at]]) + 1)))
        yield order[at : at + rows]
        at += rows


def forward(pieces: Pieces, chances: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log of the summed probability of all segmentations of each word, for each column of ``chances``."""
    out = np.zeros((len(words), chances.shape[1]))
    for at in _chunks(words):
        own = [words[i] for i in at.tolist()]
        keep = pieces.longest + 1
        sums = np.zeros((keep, len(own), chances.shape[1]))  # of the last positions only
        sums[0] = 1.0
        log, last = np.zeros(sums.shape[1:]), 0
        sizes = np.array([len(w) + 1 for w in own])

        def ended(at_end: int) -> None:
            done = np.arange(*np.searchsorted(-sizes, [-at_end, -at_end + 1]))  # longest first
            out[at[done]] = np.log(sums[at_end % keep, done]) + log[done]

        for end, length, rows, ids in _edges(pieces, own):
            if end != last:  # every byte is a piece, so no end is left out
                ended(last)
                last = end
                sums[end % keep] = 0.0
                if end % 16 == 0:  # keeps long words within the range of a double
                    top = sums.max(axis=0)
                    top[top == 0] = 1.0  # of words that have ended
                    sums /= top
                    log += np.log(top)
            sums[end % keep, rows] += sums[(end - length) % keep, rows] * chances[ids]
        ended(last)
    return out


def _cuts(pieces: Pieces, words: list[bytes], kept: bool):
    """Pieces by end position, in blocks: a function from a block's number to (end, length, row, piece id) of each.

    Ordered by end, then row. Words are longest first. ``kept``: blocks are held, not found anew.
    """
    matrix, sizes = _matrix(words)
    up, down = tb.scales(matrix.shape[1] + 1)
    sums = np.zeros((matrix.shape[1] + 1, len(words)), np.uint64)
    np.cumsum((tb.BYTE[matrix] * up[:-1]).T, axis=0, out=sums[1:])
    step = max(1, _CELLS // len(words))
    held: dict[int, tuple] = {}

    def block(at: int):
        if at in held:
            return held[at]
        ends = np.arange(at * step + 1, min((at + 1) * step, matrix.shape[1]) + 1)
        found = []
        for length in range(1, min(int(ends[-1]), pieces.longest) + 1):
            e = ends[ends >= length]
            ids = pieces.find(tb.mix((sums[e] - sums[e - length]) * down[e - length][:, None]).ravel())
            hit = np.flatnonzero(ids >= 0)
            end, row = e[hit // len(words)], hit % len(words)
            inside = end <= sizes[row]
            found.append((end[inside], np.full(int(inside.sum()), length, np.int16), row[inside].astype(np.int32), ids[hit[inside]]))
        end, length, row, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort([row, end])
        out = end[order], length[order], row[order], ids[order]
        if kept:
            held[at] = out
        return out

    return block, -(-matrix.shape[1] // step), sizes


def _expected(pieces: Pieces, chance: np.ndarray, words: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of the weighted words.

    Sums are held as logarithms at each position, so words may have any length.
    """
    counts, logs = np.zeros(pieces.size), np.log(chance)
    for at in _chunks(words):
        own, w = [words[i] for i in at.tolist()], weight[at]
        block, blocks, sizes = _cuts(pieces, own, len(own) * (len(own[0]) + 1) <= _AREA)
        fore = np.full((int(sizes[0]) + 1, len(own)), -np.inf)
        back = np.full_like(fore, -np.inf)
        fore[0] = 0.0
        back[sizes, np.arange(len(own))] = 0.0
        for b in range(blocks):
            end, length, row, ids = block(b)
            first = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(end)]):
                r = row[lo:hi]
                through = fore[end[lo] - length[lo:hi], r] + logs[ids[lo:hi]]
                new = np.flatnonzero(np.append(True, r[1:] != r[:-1]))  # every byte is a piece, so no row is left out
                top = np.maximum.reduceat(through, new)
                part = np.exp(through - np.repeat(top, np.diff(np.append(new, hi - lo))))
                fore[end[lo], r[new]] = top + np.log(np.add.reduceat(part, new))
        total = fore[sizes, np.arange(len(own))]
        for b in reversed(range(blocks)):
            end, length, row, ids = block(b)
            first = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            for lo, hi in reversed(list(zip(first.tolist(), [*first[1:].tolist(), len(end)]))):
                begin, r = end[lo] - length[lo:hi], row[lo:hi]  # a begin and a row occur once
                back[begin, r] = np.logaddexp(back[begin, r], logs[ids[lo:hi]] + back[end[lo], r])
            share = np.exp(fore[end - length, row] + logs[ids] + back[end, row] - total[row])
            counts += np.bincount(ids, share * w[row], pieces.size)
    return counts


def _fit(pieces: Pieces, texts: list[str]) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation from equal ones."""
    seen: dict[bytes, int] = {}
    for text in texts:
        for word in text.encode().split():
            seen[word] = seen.get(word, 0) + 1
    words = list(seen)
    weight = np.array([seen[w] for w in words], np.float64)
    chance = np.full(pieces.size, 1.0 / pieces.size)
    for _ in range(ROUNDS if words else 0):
        chance = _expected(pieces, chance, words, weight) + SMOOTHING
        chance /= chance.sum()
    chance *= 1 - BYTE_SHARE
    chance[:256] += BYTE_SHARE / 256
    return chance


def read_pieces(path: str) -> list[str]:
    """Pieces of a public sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not special(i)]


def fit(df: DataFrame, pieces: list[str], learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Piece probabilities for each language among the rows for which ``learn`` holds and ``lang`` isn't null.

    Each language is fitted on at most ``SAMPLE_ROWS`` rows: those with the smallest hash of the key. Words
    count whatever their length, so languages written without spaces are learned like others. The
    model has one number per language and piece, whatever the size of the table.
    """
    rows = df.filter(learn & df[lang].isNotNull() & df[text].isNotNull()).select(
        df[lang].cast("string").alias("lang"), F.xxhash64(df[key].cast("string"), F.lit("sample")).alias("draw"), F.lower(df[text]).alias("text"),
    )
    by = Window.partitionBy("lang").orderBy("draw")
    # The draw up to which rows are wanted, from narrow rows; texts are then shuffled for the sample only.
    upto = rows.select("lang", "draw").withColumn("n", F.row_number().over(by)).filter(F.col("n") <= SAMPLE_ROWS)
    upto = upto.groupBy("lang").agg(F.max("draw").alias("upto"))
    chosen = rows.join(F.broadcast(upto), "lang").filter("draw <= upto")  # one row per language
    chosen = chosen.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= SAMPLE_ROWS)
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        chance = _fit(Pieces(shared.value), group["text"].tolist())
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "chance": [chance.tobytes()]})

    out = chosen.groupBy("lang").applyInPandas(fitted, "lang string, chance binary").collect()  # one row per language
    return {r["lang"]: np.frombuffer(bytes(r["chance"])) for r in sorted(out, key=lambda r: r["lang"])}


def language_id(df: DataFrame, pieces: list[str], model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (posterior share of that language) to the rows of ``df``.

    Lower-cased words between white space are scored on their own; a word's probability in a language is
    the sum over all its segmentations into pieces, by the forward algorithm. A text has the product over
    its words. Null texts, empty texts and texts without a letter get ``und`` and 0.0, as all do if
    nothing was learned; equal scores go to the language that sorts first. Texts are read whole; repeated
    rows get equal results; an empty table gives an empty one; columns named ``lang_pred`` or ``score``
    are replaced, all others stay. One pass, no shuffle.
    """
    names = sorted(model)
    others = [c for c in df.columns if c not in ("lang_pred", "score")]
    source = df.select(
        *tb.numbered(df, others), F.lower(F.col(f"`{text}`")).alias("__text"),
        F.coalesce(F.regexp_like(F.col(f"`{text}`"), F.lit(r"\p{L}")), F.lit(False)).alias("__letter"),
    )
    chances = np.stack([model[n] for n in names], axis=1) if names else np.empty((0, 0))
    shared = df.sparkSession.sparkContext.broadcast((pieces, chances))
    held: list[Pieces] = []

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, starts, ends in tb.sliced(batch, "__text", _SLICE):
                best, score = np.full(len(starts), len(names)), np.zeros(len(starts))
                if names:
                    if not held:
                        held.append(Pieces(shared.value[0]))
                    ws, we, row = tb.words(buf, starts, ends)
                    _, first, at = np.unique(tb.hash_ranges(buf, ws, we), return_index=True, return_inverse=True)
                    raw = buf.tobytes()
                    logs = forward(held[0], shared.value[1], [raw[a:b] for a, b in zip(ws[first].tolist(), we[first].tolist())])
                    total = np.stack([np.bincount(row, logs[at, j], len(starts)) for j in range(len(names))], axis=1)
                    letter = np.asarray(part.column("__letter").to_numpy(zero_copy_only=False), bool)
                    best = np.where(letter, total.argmax(axis=1), len(names))
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    score = np.where(letter, share, 0.0)
                yield pa.RecordBatch.from_arrays(
                    part.columns[:-2] + [pa.array([*names, UNKNOWN]).take(pa.array(best)), pa.array(score)],
                    names=[*part.schema.names[:-2], "lang_pred", "score"],
                )

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema if not f.name.startswith("__"))
    return source.mapInArrow(scored, f"{kept}lang_pred string, score double").toDF(*others, "lang_pred", "score")


def _held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _vocabulary() -> list[str]:
    import public_tokenizers

    return read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def keep_known(df: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of a documents table whose language is recognised with a share of at least ``least``."""
    pieces = _vocabulary()
    source = df.select(*tb.numbered(df, df.columns))
    model = fit(df, pieces, ~_held_out(df["doc_id"]))
    out = language_id(source, pieces, model, f"c{df.columns.index('text')}").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return out.drop("lang_pred", "score").toDF(*df.columns)


@query("op8_language_id")
def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = _vocabulary()
    held_out = _held_out(docs["doc_id"])
    model = fit(docs, pieces, ~held_out)
    return language_id(docs.select("doc_id", "text", held_out.alias("held_out")), pieces, model).drop("text")
