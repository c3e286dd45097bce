"""Toxicity: a learnt lexicon in a trie, met by Levenshtein automata, and scores of the windows around the hits."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscore.llm.common import dropped, held_out, label_sample, slices, whole_text, written

FOLDS, HELD_FOLD = 3, 1
REJECT_FROM = 0.7
MAX_TRAIN = 20_000
LEAST_ROWS = 20

LEAST_TEXTS = 5
LEAST_SHARE = 0.9
STEM_LENGTHS = (4, 5, 6)
FUZZY_FROM = 4
LONG_FROM = 10  # letters from which a term may have two edits
WINDOW = 6
DISCOUNT = 0.8  # what an edit leaves of a hit
MISSPELT_SHARE = 0.1  # misspelt texts expected for each text that has the term itself
MEMO = 200_000
COUNTED_AT_ONCE = 400_000

LETTERS = re.compile(r"[^\W\d_]+")
# Quotation marks, words that report speech or name a word, words that address someone.
QUOTES = "\"'`“”„‚‘’«»‹›"
REPORTING = frozenset("said says called word term quote quoted quotes wrote insult sagte wort nannte dit mot appelé dijo palabra llamó".split())
ADDRESS = frozenset("you your you're u ur yourself du dich dir dein tu te toi vous votre usted tú".split())

FEATURES = ("abuse", "terms", "density", "quoted", "reported", "addressed", "severity")


def letters(token: str) -> str:
    return "".join(LETTERS.findall(token))


def edits_for(term: str) -> int:
    return 2 if len(term) >= LONG_FROM else 1


@dataclass
class Lexicon:
    """Terms in a trie: whole words, which may be met with edits, and stems, which begin a word exactly.

    ``common``: clean texts that hold a misspelt word, where they are several; ``trust``: by place of a term, how far other
    words near it are no chance; ``swaps``: whether a swap of neighbours is one edit.
    """

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    common: dict[str, int] = field(default_factory=dict)
    trust: dict[int, float] = field(default_factory=dict)
    swaps: bool = False

    def __post_init__(self) -> None:
        self.names = sorted({*self.words, *self.stems})
        self.place = {name: i for i, name in enumerate(self.names)}
        self.tries: dict[int, dict] = {}  # by the edits allowed
        # Parts that edits leave as they are, and how long a word with them may be: by size at either end, by place and size between.
        self.heads: dict[int, dict[str, set[int]]] = {}
        self.tails: dict[int, dict[str, set[int]]] = {}
        self.middles: dict[tuple[int, int], dict[str, set[int]]] = {}
        self.stem_sizes = sorted({len(s) for s in self.stems})
        for word in self.words:
            if len(word) >= FUZZY_FROM:
                k = edits_for(word)
                node = self.tries.setdefault(k, {})
                for c in word:
                    node = node.setdefault(c, {})
                node[""] = word
                cuts = [len(word) * j // (k + 1) for j in range(k + 2)]
                spellings = {word}
                for at in cuts[1:-1] if self.swaps else ():  # a swap over a cut changes both parts
                    spellings |= {w[:at - 1] + w[at] + w[at - 1] + w[at + 1:] for w in spellings}
                sizes = range(len(word) - k, len(word) + k + 1)
                for w in spellings:
                    self.heads.setdefault(cuts[1], {}).setdefault(w[:cuts[1]], set()).update(sizes)
                    self.tails.setdefault(len(w) - cuts[-2], {}).setdefault(w[cuts[-2]:], set()).update(sizes)
                    for x, y in zip(cuts[1:-2], cuts[2:-1]):
                        for at in range(x - k, x + k + 1):
                            self.middles.setdefault((at, y - x), {}).setdefault(w[x:y], set()).update(sizes)

    def near(self, word: str) -> tuple[int, str] | None:
        """Edits and term of the nearest term within its edits: insertions, deletions, substitutions, with ``swaps`` also those.

        The automaton of the word reads the trie: level e of its state has a bit for each place that e edits reach, and one
        for each place where the first letter of a swap has been read.
        """
        end = 1 << len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        best: tuple[int, str] | None = None
        for k, trie in self.tries.items():
            stack = [(trie, [(1 << e + 1) - 1 for e in range(k + 1)], [0] * (k + 1))]
            while stack:
                node, state, swaps = stack.pop()
                if "" in node:
                    for e, places in enumerate(state):
                        if places & end:
                            best = min(best or (e, node[""]), (e, node[""]))
                            break
                for c, child in node.items():
                    if not c:
                        continue
                    mask, after, begun = masks.get(c, 0), [], []
                    for e, places in enumerate(state):
                        reach = (places & mask) << 1
                        if e:
                            reach |= state[e - 1] | state[e - 1] << 1 | after[e - 1] << 1 | (swaps[e] & mask) << 2
                        after.append(reach & (2 * end - 1))
                        begun.append(state[e - 1] & mask >> 1 if e and self.swaps else 0)
                    if after[-1] or begun[-1]:
                        stack.append((child, after, begun))
        return best

    def part(self, word: str) -> tuple[int, int] | None:
        """Place of the term that a word is, begins with or comes near to, and the edits."""
        if word in self.words:
            return self.place[word], 0
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return self.place[word[:n]], 0
        if self.may_be_near(word):
            found = self.near(word)
            if found is not None:
                return self.place[found[1]], found[0]
        return None

    def may_be_near(self, word: str) -> bool:
        """Edits leave one of the parts of the term nearly where it is, and the length nearly so."""
        size = len(word)
        for n, heads in self.heads.items():
            if size in heads.get(word[:n], ()):
                return True
        for n, tails in self.tails.items():
            if size in tails.get(word[-n:], ()):
                return True
        for (at, n), middles in self.middles.items():
            if size in middles.get(word[at:at + n], ()):
                return True
        return False

    def weight(self, token: str, hit: tuple[int, int]) -> float:
        """What a hit counts: 1 for the term itself, less by its edits and by how far they may be chance."""
        place, edits = hit
        if not edits:
            return 1.0
        return DISCOUNT ** edits * self.trust.get(place, 1.0) / (1 + self.common.get(letters(token), 0))

    def match(self, token: str) -> tuple[int, int] | None:
        """Place of the term that a lower-case token holds, and its edits; marks left out inside a token count as one."""
        if token.isalpha():
            return self.part(token)
        parts = LETTERS.findall(token)
        for word in parts:
            hit = self.part(word)
            if hit and not hit[1]:
                return hit
        hits = [h for h in map(self.part, parts) if h]
        if not hits and len(parts) > 1 or parts and len(parts[0]) != len(token.strip(".,;:!?" + QUOTES)):
            joined = self.part("".join(parts))
            if joined:
                hits.append((joined[0], max(1, joined[1])))
        return min(hits, key=lambda h: h[1]) if hits else None


def setting(tokens: list[str], i: int) -> tuple[str, bool]:
    """Whether the token at ``i`` is ``quoted``, ``reported`` or ``meant``, and whether someone is addressed near it.

    A hit within ``WINDOW`` words after an opening and before a closing quotation mark is quoted, and one near a
    word that reports speech is reported.
    """
    token, before, after = tokens[i], tokens[max(0, i - WINDOW):i], tokens[i + 1:i + 1 + WINDOW]
    addressed = any(t.strip(".,;:!?") in ADDRESS for t in (*before, *after))
    opens = token[0] in QUOTES or any(t[0] in QUOTES for t in before)
    closes = any(t.rstrip(".,;:!?")[-1:] in QUOTES and t.rstrip(".,;:!?") for t in (token, *after))
    if opens and closes:
        return "quoted", addressed
    if any(t.strip(".,;:!?") in REPORTING for t in (*before, *after)):
        return "reported", addressed
    return "meant", addressed


def features(tokens: list[str], hits: dict[str, tuple[int, int]], lexicon: Lexicon) -> list[float]:
    """What the hits of one text amount to, in the order of ``FEATURES``, each by its weight.

    Quoted and reported hits do not count as abuse, misspelt ones do at their discount.
    """
    abuse = quoted = reported = addressed = 0.0
    terms: dict[int, float] = {}
    severity = 0.0
    for i, token in enumerate(tokens):
        hit = hits.get(token)
        if hit is None:
            continue
        weight = lexicon.weight(token, hit)
        how, someone = setting(tokens, i)
        if how == "quoted":
            quoted += weight
        elif how == "reported":
            reported += weight
        else:
            abuse += weight
            terms[hit[0]] = max(terms.get(hit[0], 0.0), weight)
            name = lexicon.names[hit[0]]
            severity = max(severity, weight * max(lexicon.words.get(name, 0.0), lexicon.stems.get(name, 0.0)))
            addressed += weight * someone
    return [float(np.log1p(abuse)), float(np.log1p(sum(terms.values()))), float(np.log1p(100 * abuse / len(tokens))), float(np.log1p(quoted)),
            float(np.log1p(reported)), float(np.log1p(addressed)), severity]


def term_counts(rows: DataFrame) -> DataFrame:
    """Rows of ``(text, label)`` with and without toxicity that hold each word and each stem: ``term, stem, toxic, clean``.

    ``places`` counts the different words that stand before it in toxic texts: a term turns up anywhere, while a
    rare word that many copies of one text share always follows the same one.
    """
    def flush(toxic: Counter, clean: Counter, before: dict) -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array([n[0] for n in names]), pa.array([n[1] for n in names]),
             pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64()),
             pa.array([sorted(before.get(n, ())) for n in names], pa.list_(pa.int64()))],
            ["term", "stem", "toxic", "clean", "before"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, before = Counter(), Counter(), {}
        for batch in slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = LETTERS.findall(text.lower())
                held = {(w, False) for w in words if len(w) >= STEM_LENGTHS[0]}
                held |= {(w[:n], True) for w in set(words) for n in STEM_LENGTHS if len(w) > n}
                (toxic if label else clean).update(held)
                if label:
                    for last, word in zip(["", *words], words):
                        place = zlib.crc32(last.encode("utf-8", "surrogatepass"))
                        for name in [(word, False), *((word[:n], True) for n in STEM_LENGTHS if len(word) > n)]:
                            before.setdefault(name, set()).add(place)
            if len(toxic) + len(clean) > COUNTED_AT_ONCE:
                yield flush(toxic, clean, before)
                toxic, clean, before = Counter(), Counter(), {}
        if toxic or clean:
            yield flush(toxic, clean, before)

    counted = rows.select("text", "label").mapInArrow(run, "term string, stem boolean, toxic long, clean long, before array<long>")
    places = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("before") > 0, F.col("before"))))))
    return counted.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), places.alias("places"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Every word and stem that stands in toxic texts and hardly in others, and what the words near them are worth."""
    counted = term_counts(rows)
    likely = counted.where((F.col("places") >= LEAST_TEXTS) & (F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))))
    lexicon = chosen(likely.orderBy(F.desc("toxic"), "stem", F.desc(F.length("term")), "term").collect())
    return with_chances(lexicon, met_counts(rows, lexicon))


def chosen(terms: list) -> Lexicon:
    """The lexicon of candidates, the most frequent first. Words behind a stem stay in it, as only words are met with edits."""
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    held: dict[str, int] = {}
    for row in terms:
        term, toxic = row["term"], row["toxic"]
        weight = float(np.log((toxic + 0.5) / (row["clean"] + 0.5)))
        if any(term[:n] in stems for n in STEM_LENGTHS):
            if not row["stem"]:
                words[term] = weight
            continue
        if row["stem"]:
            if held.get(term, 0) >= 0.8 * toxic:  # an accepted word or longer stem stands behind it
                continue
            stems[term] = weight
        else:
            words[term] = weight
        for n in STEM_LENGTHS:
            held[term[:n]] = max(held.get(term[:n], 0), toxic)
    return Lexicon(words, stems, swaps=True)


def met_words(text: str, lexicon: Lexicon, memo: dict) -> set[tuple[str, int, bool]]:
    """Words, terms and whether misspelt of the hits of a text that are neither quoted nor reported."""
    tokens = text.lower().split()
    hits = token_hits(tokens, lexicon, memo)
    return {(letters(t) if hits[t][1] else "", hits[t][0], hits[t][1] > 0)
            for i, t in enumerate(tokens) if t in hits and setting(tokens, i)[0] == "meant"}


def met_counts(rows: DataFrame, lexicon: Lexicon) -> list:
    """Of rows ``(text, label)`` with and without toxicity how many hold each hit: ``word, place, misspelt, toxic, clean``.

    Words in a single clean text are one row of their term, whose ``word`` is null.
    """
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)  # terms of at most MAX_TRAIN texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in slices(batches):
            met = [(*hit, label) for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist())
                   for hit in met_words(text, sent.value, memo)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[i] for m in met], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int32()))],
                ["word", "place", "misspelt", "label"])

    met = rows.select("text", "label").mapInArrow(run, "word string, place long, misspelt boolean, label int")
    counts = met.groupBy("word", "place", "misspelt").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    counts = counts.withColumn("word", F.when(~F.col("misspelt") | (F.col("clean") > 1), F.col("word")))
    return counts.groupBy("word", "place", "misspelt").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()


def with_chances(lexicon: Lexicon, counts: list) -> Lexicon:
    """The lexicon with what clean texts say of words near its terms.

    A misspelt word that several clean texts hold is chance. Where clean texts hold many others, each once, further ones of
    that term will turn up in clean texts as well.
    """
    common = {r["word"]: r["clean"] for r in counts if r["misspelt"] and r["word"] is not None}
    sure = {r["place"]: r["toxic"] for r in counts if not r["misspelt"]}
    trust = {}
    for r in counts:
        if r["misspelt"] and r["word"] is None and r["clean"]:
            expected = max(1.0, MISSPELT_SHARE * sure.get(r["place"], 0))
            trust[r["place"]] = expected / (expected + r["clean"])
    return replace(lexicon, common=common, trust=trust)


def token_hits(tokens: list[str], lexicon: Lexicon, memo: dict) -> dict[str, tuple[int, int]]:
    """Hits of the tokens of a text. A word is matched once while the memo, which is bounded, holds it."""
    hits = {}
    for token in set(tokens):
        if token in memo:
            hit = memo[token]
        else:
            hit = memo[token] = lexicon.match(token)
        if hit is not None:
            hits[token] = hit
    if len(memo) > MEMO:
        memo.clear()
    return hits


def text_features(texts: list[str], lexicon: Lexicon, memo: dict) -> np.ndarray:
    """Features of some texts."""
    x = np.zeros((len(texts), len(FEATURES)))
    for row, text in enumerate(texts):
        tokens = text.lower().split()
        hits = token_hits(tokens, lexicon, memo)
        if hits:
            x[row] = features(tokens, hits, lexicon)
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights and intercept by Newton steps; the ridge keeps them finite where the classes part."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """A lexicon, and the weights of the features with the intercept last."""

    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, texts: list[str], memo: dict) -> np.ndarray:
        return 1 / (1 + np.exp(-(text_features(texts, self.lexicon, memo) @ self.weights[:-1] + self.weights[-1])))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon and weights learnt from at most ``MAX_TRAIN`` labelled rows, the first by a hash of their id, none of the held-out fold.

    Labels of one class, or fewer than ``LEAST_ROWS``, give their smoothed rate as score; no labels give score 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in slices(batches):
            x = text_features(batch.column("text").to_pylist(), sent.value, memo)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "label", "x"])

    sample = label_sample(labels, id_col, label_col, FOLDS, HELD_FOLD, MAX_TRAIN)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    rows = written(rows.join(F.broadcast(sample), "id").select("id", "text", "label"), "sample")  # at most MAX_TRAIN rows of two numbers
    lexicon = learn_lexicon(rows)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms of at most MAX_TRAIN texts
    train = rows.mapInArrow(run, "id long, label int, x array<double>")
    train = train.orderBy(F.xxhash64("id"), "id", "x").limit(MAX_TRAIN).toPandas()  # ids may repeat
    dropped(rows)
    y = train["label"].to_numpy().astype(float)
    weights = np.zeros(len(FEATURES) + 1)
    if not len(y):
        weights[-1] = -np.inf
    elif len(y) < LEAST_ROWS or y.min() == y.max():
        weights[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    else:
        x = np.stack(train["x"].to_numpy())
        order = np.lexsort((*x.T, train["id"].to_numpy()))
        weights = fit_logistic(x[order], y[order])
    return Model(lexicon, weights)


def score_texts(spark: SparkSession, model: Model):
    """A function of the text column that gives the score."""
    sent = spark.sparkContext.broadcast(model)  # terms of at most MAX_TRAIN texts and a few weights

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict = {}
        for part in texts:
            yield pd.Series(sent.value.scores(part.tolist(), memo))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Probability that a text is toxic, for every row.

    Returns ``id_col``, ``held_out``, ``score`` and ``predicted`` (score at least 0.7). Whole texts are read in one pass without a shuffle; for the
    model see :func:`fit_toxicity`. Null and empty texts have no hit. Without labels the score is 0, as nothing speaks
    against a text. Repeated rows score alike. Other columns are left out. No rows give no rows.
    """
    score = score_texts(docs.sparkSession, fit_toxicity(docs, labels, id_col, text_col, label_col))
    scored = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col, FOLDS, HELD_FOLD).alias("held_out"),
                         score(whole_text(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT_FROM).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` whose score is below 0.7, with all their columns."""
    score = score_texts(docs.sparkSession, fit_toxicity(docs, labels, id_col, text_col, label_col))
    return docs.where(score(whole_text(text_col)) < REJECT_FROM)
