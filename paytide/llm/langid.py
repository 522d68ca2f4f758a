"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled text. A text is parsed
greedily into the longest matches with the language's text; a language that needs few phrases resembles
it. With reference texts of n_L letters the number of phrases times log2(n_L) per letter estimates the
cross-entropy; a letter that the language's sample lacks is a phrase of its own and also costs log2 of the
number of letters known to any language. The lowest sum wins.

Each language has its own alphabet, all letters of its sample. Its automaton is stored sparsely, as rows of
a state's moves laid over each other in one array: a slot holds the state that owns it and the next state, so
memory follows the moves and not states times letters. A move that the automaton lacks ends the phrase and
starts the next one with that letter. Texts are parsed in blocks of BLOCK letters (each block starts a
phrase), many blocks at once by table look-ups in numpy.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ready, widened, written

#: Training sample of each language: at most so many letters, of so many documents, of each document so many.
LETTERS, DOCUMENTS, OF_EACH = 60_000, 400, 1_000
#: Letters of all samples together: with more than 100 languages each gets an equal share.
ALL_LETTERS = 6_000_000
#: Languages up to which the table of their shares is broadcast; more are joined as Spark chooses.
BROADCAST_LANGUAGES = 100_000
BLOCK = 512
BATCH_LETTERS = 4_000_000
UNKNOWN = "und"
_POINTS = 0x110000
GAP = 1  # the code of a run of other characters; 0 is a letter that a language lacks

_letters: np.ndarray | None = None


def is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(_POINTS)), dtype=bool, count=_POINTS)
    return _letters


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def automaton(codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The moves (state, letter, next state) of a sequence's suffix automaton and the number of states; 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = links[p]
        if p >= 0:
            q = moves[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
    letter = np.fromiter((c for m in moves for c in m), np.int64, len(state))
    following = np.fromiter((t for m in moves for t in m.values()), np.int64, len(state))
    return state, letter, following, len(moves)


def laid_out(state: np.ndarray, letter: np.ndarray, following: np.ndarray, states: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse parse moves: slots (owner << 32 | next) at base + letter, and the start move of each letter.

    A state is named by its base; bases are drawn at random for many states at once, those of most moves first,
    and drawn again while a base or a slot is taken. The root owns no slot: its moves are the start moves.
    """
    random = np.random.default_rng(7)
    inner = state > 0
    size = 4 * max(int(inner.sum()), states, 64)
    base = np.zeros(states, dtype=np.int64)
    used = np.zeros(size + width, dtype=bool)
    named = np.zeros(size, dtype=bool)
    named[0] = True  # the root
    degree = np.bincount(state, minlength=states)
    degree[0] = 0
    at = np.cumsum(np.bincount(state, minlength=states)) - np.bincount(state, minlength=states)
    for least, most in ((32, width), (12, 31), (5, 11), (2, 4), (1, 1), (0, 0)):
        todo = np.flatnonzero((degree >= least) & (degree <= most))
        todo = todo[todo > 0]
        todo = todo[np.argsort(-degree[todo], kind="stable")]
        while len(todo):
            drawn = random.integers(1, size, len(todo))
            free = ~named[drawn]
            order = np.unique(drawn, return_index=True)[1]
            once = np.zeros(len(todo), dtype=bool)
            once[order] = True
            rank = np.repeat(np.arange(len(todo)), degree[todo])
            move = np.repeat(at[todo], degree[todo]) + np.arange(len(rank)) - np.repeat(np.cumsum(degree[todo]) - degree[todo], degree[todo])
            slot = drawn[rank] + letter[move]
            won = np.zeros(len(slot), dtype=bool)
            won[np.unique(slot, return_index=True)[1]] = True
            won &= ~used[slot]
            good = free & once & (np.bincount(rank, weights=~won, minlength=len(todo)) == 0)
            base[todo[good]] = drawn[good]
            named[drawn[good]] = True
            used[slot[good[rank]]] = True
            todo = todo[~good]
    slots = np.full(size + width, -1, dtype=np.int64)
    slots[base[state[inner]] + letter[inner]] = base[state[inner]] << 32 | base[following[inner]]
    start = np.zeros(width, dtype=np.int64)
    start[letter[~inner]] = base[following[~inner]]
    return slots, start


class Model:
    """What is learned: of each language its name and sample; alphabets and automata are built where used."""

    def __init__(self, samples: dict[str, str]):
        self.texts = {k: v for k, v in sorted(samples.items()) if v}
        self.names = list(self.texts)
        self.bits: list[float] = []
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def __getstate__(self):
        return self.__dict__ | {"tables": [], "bits": [], "codes": None}

    def built(self) -> Model:
        if not self.tables:
            known = np.unique(np.concatenate([points(t.lower()) for t in self.texts.values()])) if self.texts else np.zeros(0, np.uint32)
            known = known[is_letter()[known]]
            self.codes = np.where(is_letter(), 0, GAP).astype(np.int32)
            self.codes[known] = np.arange(len(known)) + 2
            self.filler = len(known) + 2
            self.literal = float(np.log2(max(len(known), 2)))
            for t in self.texts.values():
                codes, _, _ = self.coded([t])
                own = np.unique(np.append(codes, GAP))
                local = np.zeros(self.filler + 1, dtype=np.int64)
                local[own] = np.arange(len(own)) + 1  # 0: a letter that this language lacks, and the filler
                width = len(own) + 1
                slots, start = laid_out(*automaton(local[codes].tolist()), width)
                self.tables.append((local, slots, start))
                self.bits.append(float(np.log2(max(len(codes), 2))))
        return self

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts in a row with runs of other characters as one gap, codes of each, and whether it has a letter."""
        lower = [" " + t.lower() for t in texts]
        raw = points("".join(lower))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
        codes = self.codes[raw]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP) | (owner[1:] != owner[:-1])
        lettered = np.bincount(owner[codes != GAP], minlength=len(texts)) > 0
        return codes[keep], np.bincount(owner[keep], minlength=len(texts)), lettered

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases and, of these, lacking letters by text and language (in two layers), letters of each text, and whether it has a letter."""
        codes, sizes, lettered = self.coded(texts)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grid = np.full((BLOCK, int(blocks.sum())), self.filler, dtype=np.int32)
        grid[at % BLOCK, np.repeat(first, sizes) + at // BLOCK] = codes
        owner = np.repeat(np.arange(len(texts)), blocks)
        fillers = blocks * BLOCK - sizes
        counts = np.zeros((2, len(texts), len(self.names)))
        for k, (local, slots, start) in enumerate(self.tables):
            state = np.zeros(grid.shape[1], dtype=np.int64)
            n = np.zeros(grid.shape[1], dtype=np.int64)
            lacking = np.zeros(grid.shape[1], dtype=np.int64)
            for row in grid:
                letter = local[row]
                slot = slots[state + letter]
                ends = slot >> 32 != state
                state = np.where(ends, start[letter], slot & 0xFFFFFFFF)
                n += ends
                lacking += letter == 0
            for layer, of_blocks in enumerate((n, lacking)):  # a filler counts as a lacking letter
                counts[layer, :, k] = np.bincount(owner, weights=of_blocks, minlength=len(texts)) - fillers
        return counts, sizes, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Names and scores: 1 - lowest / second lowest rate of normalised phrases (1 with one language)."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and self.names]
        while todo:
            room, some = BATCH_LETTERS, []
            while todo and (not some or len(texts[todo[0]]) <= room):
                some.append(todo.pop(0))
                room -= len(texts[some[-1]])
            counts, _, lettered = self.phrases([texts[i] for i in some])
            rates = counts[0] * np.array(self.bits) + counts[1] * self.literal
            best = rates.argmin(axis=1)
            for j, i in enumerate(some):
                if lettered[j]:
                    names[i] = self.names[best[j]]
                    rest = np.delete(rates[j], best[j])
                    scores[i] = float(1 - rates[j, best[j]] / rest.min()) if len(rest) and rest.min() > 0 else 1.0
        return names, scores


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model of all labelled languages. The sample is bounded: for each language the DOCUMENTS rows of lowest
    hash, OF_EACH letters from the middle of each, LETTERS in all (less when all languages together would pass
    ALL_LETTERS); rows are thinned by their hash before they are ranked, so no task gets all rows of a language."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    share = rows.groupBy("lang").agg((4 * DOCUMENTS * 1_000_000 / F.count("*") + 1).alias("share"))
    share = written(share, "languages")
    if share.count() <= BROADCAST_LANGUAGES:  # rows are thinned where they lie, before they are dealt by language
        share = F.broadcast(share)
    start = F.greatest(F.lit(1), ((F.length("text") - OF_EACH) / 2).cast("int"))
    hashed = rows.select("lang", F.abs(F.xxhash64("key", F.length("text")) % 1_000_000).alias("h"), F.substring("text", start, F.lit(OF_EACH)).alias("text"))
    thin = hashed.join(share, "lang").filter(F.col("h") < F.col("share"))
    lowest = thin.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= DOCUMENTS)
    sample: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for r in lowest.orderBy("lang", "rank").select("lang", "text").toLocalIterator():
        if sizes.get(r["lang"], 0) < LETTERS:
            sample.setdefault(r["lang"], []).append(r["text"])
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + len(r["text"]) + 1
    each = min(LETTERS, ALL_LETTERS // max(len(sample), 1))
    return Model({name: "\n".join(got)[:each] for name, got in sample.items()})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and lang_pred, score of every whole text.

    Null texts and texts without a letter get "und" and 0. Ties go to the first name in order. Repeated rows
    are judged each; an empty table gives no rows; columns named like a result are replaced.
    """
    spark: SparkSession = docs.sparkSession
    ready(spark)
    names = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = widened(inner.drop("t").schema, "lang_pred string, score double")
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        got = shared.value.built()
        for batch in batches:
            lang, score = got.predict(batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "score")
