"""Language identification by unigram pieces with all segmentations summed.

Each language has its own probabilities over the pieces of one fixed public vocabulary, learned by
expectation maximisation. A word's probability in a language is the sum over all ways to cut it
into pieces, by the forward algorithm; a text's is the product over all its words. Words are
lower-cased and start with the vocabulary's word mark; words of over 32 bytes are scored as
consecutive parts, so that a text without spaces costs no more than any other. Bytes that no piece
covers fall back to byte pieces.

Null texts and texts without a letter are `und` with score 0, as is everything if no labelled row
exists. Rows with a null language are scored but not learned from. Equal scores go to the language
that is first by code point. Repeated rows are scored alike, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.llm import text as tx
from quaymetrics.llm.suffixes import order_pairs

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
LONGEST_PIECE = 16
LONGEST_WORD = 32
#: Labelled documents that each language learns from, about.
SAMPLE = 1000
ROUNDS = 4
SMOOTHING = 0.05
#: Distinct words whose scores a task remembers, and words fitted together.
REMEMBERED = 200_000
FITTED = 20_000
RESULT = "doc_id long, lang_pred string, score double"


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The pieces as bytes, a space for the word mark, and all single bytes at the end."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words = (
        model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    )
    pieces = {w.lower() for w in words if 0 < len(w) <= LONGEST_PIECE}
    return sorted(pieces | {bytes([b]) for b in range(256)})


def _keys(eights: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    low = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - 8 * min(length, 8))
    key = eights[at] & low
    if length > 8:
        rest = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - 8 * (length - 8))
        key = tx.mix64(key) ^ (eights[at + 8] & rest)
    return key


def _eights(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes from each place on as one number, and the buffer that holds them."""
    padded = np.concatenate([raw, np.zeros(24, np.uint8)])
    return np.ndarray((len(padded) - 8,), np.dtype("<u8"), padded, strides=(1,)), padded


class Pieces:
    """Finds the pieces among substrings, length by length."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(lengths) - lengths
        eights, _ = _eights(raw)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            keys = _keys(eights, starts[own], int(length))
            sort = np.argsort(keys)
            seen = np.zeros(1 << 16, bool)
            seen[self._slot(keys)] = True
            self.tables[int(length)] = keys[sort], own[sort], seen

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)

    def find(self, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are pieces of this length, and which pieces."""
        table, ids, seen = self.tables[length]
        maybe = np.flatnonzero(seen[self._slot(keys)])
        place = np.minimum(np.searchsorted(table, keys[maybe]), len(table) - 1)
        hit = table[place] == keys[maybe]
        return maybe[hit], ids[place[hit]]


class Lattice:
    """All cuts of a list of words into pieces, as edges between places in the words."""

    def __init__(self, raw: np.ndarray, lengths: np.ndarray, pieces: Pieces):
        self.n_words = len(lengths)
        stops = np.cumsum(lengths + 1)
        self.first = stops - (lengths + 1)  # a word of n bytes has n + 1 places
        self.last = stops - 1
        self.n_places = int(stops[-1]) if len(stops) else 0
        eights, _ = _eights(raw)
        word = np.repeat(np.arange(len(lengths)), lengths)
        offset = tx.ranges(np.zeros(len(lengths), np.int64), lengths)
        left = lengths[word] - offset
        place = self.first[word] + offset
        begin, size, piece, level = [], [], [], []
        for length in pieces.tables:
            at = np.flatnonzero(left >= length)
            hit, ids = pieces.find(_keys(eights, at, length), length)
            begin.append(place[at[hit]].astype(np.int32))
            level.append((offset[at[hit]] + length).astype(np.int32))
            size.append(np.full(len(hit), length, np.int32))
            piece.append(ids.astype(np.int32))
        begin, size, piece, level = (
            np.concatenate(x) if x else np.zeros(0, np.int32) for x in (begin, size, piece, level)
        )
        end = begin + size
        sort = order_pairs(level.astype(np.int64), end.astype(np.int64))
        self.begin, self.end, self.piece = begin[sort], end[sort], piece[sort]
        level = level[sort]
        self.levels = np.searchsorted(level, np.arange(1, int(level.max(initial=0)) + 2))

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Summed probability of all cuts up to each place; one column per language."""
        reach = np.zeros((self.n_places, probability.shape[1]))
        reach[self.first] = 1.0
        for a, b in zip(self.levels[:-1], self.levels[1:], strict=True):
            if a == b:
                continue
            end = self.end[a:b]
            heads = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            mass = reach[self.begin[a:b]] * probability[self.piece[a:b]]
            reach[end[heads]] = np.add.reduceat(mass, heads, axis=0)
        return reach

    def expected(self, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of times that each piece is used, over words of the given weights."""
        reach = self.forward(probability[:, None])[:, 0]
        rest = np.zeros(self.n_places)
        total = reach[self.last]
        rest[self.last] = weight / np.where(total > 0, total, 1)
        for a, b in zip(self.levels[:-1][::-1], self.levels[1:][::-1], strict=True):
            # all edges that end at this distance from the word's start
            np.add.at(rest, self.begin[a:b], rest[self.end[a:b]] * probability[self.piece[a:b]])
        use = reach[self.begin] * probability[self.piece] * rest[self.end]
        return np.bincount(self.piece, use, len(probability))


def word_parts(column: pa.Array) -> tuple[tx.Words, np.ndarray]:
    """Words of lower-cased texts, long ones cut at character starts; and which begin a word."""
    words = tx.Words(pc.utf8_lower(tx.as_strings(column)))
    lengths = words.ends - words.starts
    n = -(-lengths // LONGEST_WORD)
    starts = np.repeat(words.starts, n) + LONGEST_WORD * tx.ranges(np.zeros(len(n), np.int64), n)
    begins = np.zeros(len(starts), bool)
    begins[np.cumsum(n) - n] = True
    stops = np.repeat(words.ends, n)
    for _ in range(3):
        inside = ~begins & (starts < stops)
        inside[inside] = (words.raw[starts[inside]] & 0xC0) == 0x80
        starts[inside] += 1
    ends = stops.copy()
    ends[:-1][~begins[1:]] = starts[1:][~begins[1:]]
    words.starts, words.ends = starts, ends
    words.bounds = np.searchsorted(starts, words.offsets)
    return words, begins


def word_keys(words: tx.Words, begins: np.ndarray) -> np.ndarray:
    return words.hashes() ^ np.where(begins, np.uint64(1), np.uint64(0))


def marked(words: tx.Words, begins: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of chosen words, each with its leading space if it begins a word."""
    starts, sizes = words.starts[chosen], (words.ends - words.starts)[chosen]
    mark = begins[chosen].astype(np.int64)
    raw = np.full(int((sizes + mark).sum()), 32, np.uint8)
    to = np.cumsum(sizes + mark) - sizes
    raw[tx.ranges(to, sizes)] = words.raw[tx.ranges(starts, sizes)]
    return raw, sizes + mark


class WordScores:
    """Log-probabilities of words per language; remembers the words of earlier chunks."""

    def __init__(self, pieces: Pieces, table: np.ndarray):
        self.pieces, self.table = pieces, table
        self.keys, self.logs = np.zeros(0, np.uint64), np.zeros((0, table.shape[1]))

    def of(self, words: tx.Words, begins: np.ndarray) -> np.ndarray:
        keys, first, which = np.unique(
            word_keys(words, begins), return_index=True, return_inverse=True
        )
        logs = np.zeros((len(keys), self.table.shape[1]))
        new = np.ones(len(keys), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            new = self.keys[place] != keys
            logs[~new] = self.logs[place[~new]]
        if new.any():
            lattice = Lattice(*marked(words, begins, first[new]), self.pieces)
            logs[new] = np.log(lattice.forward(self.table)[lattice.last])
        if len(self.keys) + new.sum() > REMEMBERED:
            self.keys, self.logs = keys, logs
        else:
            every = np.concatenate([self.keys, keys[new]])
            sort = np.argsort(every)
            self.keys, self.logs = every[sort], np.concatenate([self.logs, logs[new]])[sort]
        return logs[which]


def score_texts(
    batches: Iterator[pa.RecordBatch], pieces: Pieces, languages: list[str], table: np.ndarray
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunks of the batches with the language and score of each row."""
    scores = WordScores(pieces, table)
    for chunk in tx.merged(batches):
        texts = tx.as_strings(chunk.column("text"))
        letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        n = chunk.num_rows
        names, score = np.full(n, UNKNOWN, object), np.zeros(n)
        words, begins = word_parts(texts)
        if len(words) and languages:
            logs = scores.of(words, begins)
            ran = np.concatenate([np.zeros((1, len(languages))), np.cumsum(logs, axis=0)])
            total = ran[words.bounds[1:]] - ran[words.bounds[:-1]]
            best = total.argmax(axis=1)
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            share = odds.max(axis=1) / odds.sum(axis=1)
            names[letters] = np.array(languages, object)[best[letters]]
            score[letters] = share[letters]
        yield chunk, names, score


def predictions(
    batches: Iterator[pa.RecordBatch], pieces: Pieces, languages: list[str], table: np.ndarray
) -> Iterator[pa.RecordBatch]:
    for chunk, names, score in score_texts(batches, pieces, languages, table):
        yield pa.record_batch(
            [chunk.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )


def known_rows(
    batches: Iterator[pa.RecordBatch],
    pieces: Pieces,
    languages: list[str],
    table: np.ndarray,
    at_least: float,
) -> Iterator[pa.RecordBatch]:
    for chunk, names, score in score_texts(batches, pieces, languages, table):
        yield chunk.filter(pa.array((names != UNKNOWN) & (score >= at_least)))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each chunk, the word with its leading space."""
    for chunk in tx.merged(batches):
        langs = chunk.column("lang").dictionary_encode()
        words, begins = word_parts(chunk.column("text"))
        if not len(words):
            continue
        _, first, which = np.unique(
            word_keys(words, begins), return_index=True, return_inverse=True
        )
        raw, lengths = marked(words, begins, first)
        code = np.repeat(langs.indices.to_numpy(), np.diff(words.bounds))
        pair, n = np.unique(code.astype(np.int64) * len(lengths) + which, return_counts=True)
        ends = np.cumsum(lengths)
        own = [raw[e - s : e].tobytes() for e, s in zip(ends, lengths, strict=True)]
        yield pa.record_batch(
            [
                langs.dictionary.take(pa.array(pair // len(lengths))),
                pa.array([own[w] for w in pair % len(lengths)], pa.binary()),
                pa.array(n, pa.int64()),
            ],
            names=["lang", "word", "n"],
        )


def fit_language(words: pd.DataFrame, pieces: Pieces, rounds: int) -> pd.DataFrame:
    """Piece probabilities of one language by expectation maximisation over its counted words."""
    words = words.sort_values("word")
    own = [bytes(w) for w in words["word"]]
    weight = words["n"].to_numpy(float)
    probability = np.full(pieces.n, 1.0 / pieces.n)
    for _ in range(rounds):
        use = np.full(pieces.n, SMOOTHING)
        for a in range(0, len(own), FITTED):  # cuts are made anew: all of them would fill a task
            part = own[a : a + FITTED]
            raw = np.frombuffer(b"".join(part), np.uint8)
            lattice = Lattice(raw, np.array([len(w) for w in part], np.int64), pieces)
            use += lattice.expected(probability, weight[a : a + FITTED])
        probability = use / use.sum()
    tx.give_back()
    return pd.DataFrame(
        {"lang": words["lang"].iloc[0], "piece": np.arange(pieces.n), "probability": probability}
    )


def sampled(labelled: DataFrame, per_language: int) -> DataFrame:
    """About `per_language` rows of each language, by a hash of the row."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    for lang, n in sizes.items():
        limit = int((1 << 30) * min(1.0, per_language / n))
        keep = keep | ((F.col("lang") == lang) & (draw < limit))
    return labelled.where(keep)


def train(
    labelled: DataFrame,
    vocabulary: str = VOCABULARY,
    per_language: int = SAMPLE,
    rounds: int = ROUNDS,
) -> tuple[list[bytes], list[str], np.ndarray]:
    """Pieces, languages and their piece probabilities, learned from rows of text and lang.

    Each language learns from about `per_language` documents, whole texts; the documents of a
    language are drawn by a hash, so the model is the same on every run.
    """
    names = load_pieces(vocabulary)
    pieces = Pieces(names)
    rows = sampled(
        labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
            F.col("lang").isNotNull() & F.col("text").isNotNull()
        ),
        per_language,
    )
    counts = (
        rows.select("text", "lang")
        .mapInArrow(count_words, "lang string, word binary, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    fitted = counts.groupBy("lang").applyInPandas(
        lambda words: fit_language(words, pieces, rounds),
        "lang string, piece int, probability double",
    )
    found: dict[str, np.ndarray] = {}
    packed = fitted.groupBy("lang").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("piece", "probability"))), lambda x: x["probability"]
        ).alias("p")
    )
    for row in packed.toArrow().to_pylist():
        found[row["lang"]] = np.array(row["p"])
    languages = sorted(found)
    table = np.stack([found[x] for x in languages], axis=1) if found else np.zeros((len(names), 0))
    return names, languages, table


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of all documents that nothing is learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def identify(docs: DataFrame, model: tuple[list[bytes], list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of each document; score is the share of the best language."""
    tx.require_columns(docs, "doc_id", "text")
    names, languages, table = model
    pieces = Pieces(names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: predictions(batches, pieces, languages, table), RESULT
    )


def identify_by_labels(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Learn from the documents that are not held out, and score all of them."""
    model = train(docs.where(~held_out()), vocabulary)
    return identify(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def keep_known(docs: DataFrame, at_least: float = 0.5, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows whose text is in a learned language by a score of `at_least`, as they were."""
    names, languages, table = train(docs.where(~held_out()), vocabulary)
    pieces = Pieces(names)
    return docs.mapInArrow(
        lambda batches: known_rows(batches, pieces, languages, table, at_least), docs.schema
    )
