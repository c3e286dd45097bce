"""Integrated-gradients scores per token and highlighted text.

For the model ``b + W tanh(mean of token vectors)`` the path integral from
the zero vector has a closed form. With mean ``m`` over ``T`` tokens and class
weights ``w`` the score of a token with vector ``e`` is the mean over the
dimensions of ``e * w * tanh(m) / (m T)``; at ``m = 0`` the fraction is 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.corpus import Corpus
from textscore.functions.vectors import argmax, array_sum, dot
from textscore.operators import scoring
from textscore.operators.matrix import TokenMatrix, ids_of, parts_of, token_parts
from textscore.operators.bpe import encode_text
from textscore.operators.sampling import filter_load
from textscore.operators.scoring import dan_logit_arrays, model_column
from textscore.session import via_table

# Colours at the least, the median and the greatest score.
RED, WHITE, GREEN = (206, 35, 35), (255, 255, 255), (22, 206, 16)
PALETTE_STEPS = 256
PATH_STEPS = 50
#: Numbers of a padded batch of token vectors, of which a step holds a few copies: as many as stay in a core's cache.
PADDED_NUMBERS = 65_536
#: ``(vectors, mask, target) -> (logits, gradient of the target's logit)``
Network = Callable[[np.ndarray, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray | None]]
# What stands before and after a coloured token.
MARK_OPEN, MARK_CLOSE = '<mark style="margin: 0; padding: 0; background-color:', "</mark>"


def _mean_slope_exact(m: Column) -> Column:
    return F.when(m == 0, F.lit(1.0)).otherwise(F.tanh(m) / m)


def _mean_slope_numeric(steps: int):
    """Gauss-Legendre mean of ``1 - tanh(a m)**2`` for a between 0 and 1."""
    at, weight = np.polynomial.legendre.leggauss(steps)
    path = F.array(*[
        F.struct(F.lit(float((a + 1) / 2)).alias("a"), F.lit(float(w / 2)).alias("w")) for a, w in zip(at, weight)
    ])

    def slope(m: Column) -> Column:
        return F.aggregate(
            path, F.lit(0.0), lambda acc, p: acc + p["w"] * (1 - F.tanh(p["a"] * m) * F.tanh(p["a"] * m))
        )

    return slope


def ig_factors(pooled: DataFrame, id: str, weights: DataFrame, dim: int, slope=_mean_slope_exact) -> DataFrame:
    """What a token vector is multiplied with: one array per document.

    The target is the class of the greatest logit, unless ``pooled`` has a
    column ``y_pred`` that names it.
    """
    scored = dan_logit_arrays(pooled, weights)
    if "y_pred" not in pooled.columns:
        scored = scored.withColumn("y_pred", argmax(F.col("z")))
    scored = scored.withColumn("_model", model_column(weights))
    w = F.get("_model", F.col("y_pred"))["w"]
    factor = F.zip_with("m", w, lambda m, x: x.cast("double") * slope(m) / F.col("n_tokens") / dim)
    return scored.select(id, "n_tokens", "z", "y_pred", factor.alias("factor"))


def _slopes(m: np.ndarray, steps: int | None) -> np.ndarray:
    if steps is None:
        return np.where(m == 0, 1.0, np.tanh(m) / np.where(m == 0, 1.0, m))
    at, weight = np.polynomial.legendre.leggauss(steps)
    return sum(w / 2 * (1 - np.tanh((a + 1) / 2 * m) ** 2) for a, w in zip(at, weight))


def score_lists(ids: pa.ListArray, target: np.ndarray | None, matrix: TokenMatrix, w: np.ndarray, b: np.ndarray,
                steps: int | None) -> pa.StructArray:
    """Scores, predicted class and logits of a batch of id lists, a bounded number of tokens at a time."""
    flat, lengths = ids_of(ids)
    places = matrix.places(flat)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    n = np.maximum(lengths, 1)[:, None]
    m = matrix.sums(places, doc, len(lengths)) / n
    z = np.tanh(m) @ w.T + b
    chosen = z.argmax(axis=1) if target is None else target
    factor = w[chosen] * _slopes(m, steps) / n / w.shape[1]
    scores = [np.einsum("ij,ij->i", matrix.take(places[part]), factor[doc[part]]) for part in token_parts(len(places))]
    ends = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    each = pa.array(np.arange(len(lengths) + 1) * len(b), pa.int32())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *scores]))), pa.array(chosen, pa.int32()),
         pa.ListArray.from_arrays(each, pa.array(z.ravel()))], ["scores", "y_pred", "z"])


def token_scores(docs: DataFrame, id: str, ids: str, vecs: DataFrame, weights: DataFrame, dim: int,
                 steps: int | None = None) -> DataFrame:
    """Add ``scores`` (one per token), ``y_pred`` and ``z`` to every document.

    The target is the class of the greatest logit, unless ``docs`` has a column ``y_pred`` that
    names it. All a document needs lies in its row, so this is one map without a shuffle; the matrix of
    vectors travels to the tasks after its numbers were counted. A larger matrix is
    joined to the distinct tokens of each document, and one number per pair comes back.
    ``steps`` takes the integral by quadrature instead of its closed form.
    """
    matrix = scoring.mapped_matrix(vecs, dim)
    if matrix is None:
        return _scores_by_pairs(docs, id, ids, vecs, weights, dim, steps)
    classes = weights.select("class", F.col("w").cast("array<double>").alias("w"), "b").toPandas().sort_values("class")
    model = docs.sparkSession.sparkContext.broadcast((np.stack(classes["w"].to_numpy()), classes["b"].to_numpy(float)))
    kind = "struct<scores:array<double>,y_pred:int,z:array<double>>"

    @F.arrow_udf(kind)
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield from parts_of(lambda part: score_lists(part, None, matrix.value, *model.value, steps), lists)

    @F.arrow_udf(kind)
    def named(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def of_part(part: pa.Array, y: pa.Array) -> pa.Array:
            return score_lists(part, y.to_numpy(zero_copy_only=False).astype(np.int64), matrix.value, *model.value, steps)

        for lists, target in batches:
            yield from parts_of(of_part, lists, target)

    given = "y_pred" in docs.columns
    lists = F.col(ids).cast("array<int>")
    found = docs.withColumn("_scored", named(lists, F.col("y_pred").cast("int")) if given else best(lists))
    kept = [c for c in docs.columns if c not in ("scores", "y_pred", "z")]
    return found.select(*kept, "_scored.scores", "_scored.y_pred", "_scored.z")


def _scores_by_pairs(docs: DataFrame, id: str, ids: str, vecs: DataFrame, weights: DataFrame, dim: int, steps: int | None) -> DataFrame:
    pooled = scoring.mean_pool(docs, id, ids, vecs, dim)
    if "y_pred" in docs.columns:
        pooled = pooled.join(docs.select(id, "y_pred"), id)
    slope = _mean_slope_exact if steps is None else _mean_slope_numeric(steps)
    factors = ig_factors(pooled, id, weights, dim, slope)
    pairs = docs.select(id, F.explode_outer(F.array_distinct(ids)).alias("token_id")).where(F.col("token_id").isNotNull())
    pairs = scoring.lookup_vectors(pairs.join(factors.select(id, "factor"), id), vecs, F.col(id))
    by_token = pairs.groupBy(id).agg(
        F.map_from_entries(F.collect_list(F.struct("token_id", dot(F.col("v"), F.col("factor")).alias("s")))).alias("_by_token"))
    kept = [c for c in docs.columns if c not in ("scores", "y_pred", "z")]
    return docs.select(*kept).join(factors.select(id, "y_pred", "z"), id, "left").join(by_token, id, "left").select(
        *kept, F.transform(ids, lambda i: F.element_at("_by_token", i)).alias("scores"), "y_pred", "z")


def explode_scores(scored: DataFrame, id: str, ids: str, tokens: str | None = None, *more: str) -> DataFrame:
    """One row per token: ``(id, pos, token_id, token, score)`` and other arrays of the same length."""
    parts = [F.col(ids).alias("token_id")] + ([F.col(tokens).alias("token")] if tokens else [])
    parts += [F.col("scores").alias("score"), *[F.col(c) for c in more]]
    rows = scored.select(id, F.posexplode(F.arrays_zip(*parts)).alias("pos", "_t"))
    return rows.select(id, "pos", "_t.*")


def ig_scores(docs: DataFrame, id: str, ids: str, vecs: DataFrame, weights: DataFrame, dim: int,
              tokens: str | None = None) -> DataFrame:
    """One row per token: ``(id, pos, token id, token, score)``."""
    return explode_scores(token_scores(docs, id, ids, vecs, weights, dim), id, ids, tokens)


def ig_scores_numeric(docs: DataFrame, id: str, ids: str, vecs: DataFrame, weights: DataFrame, dim: int,
                      tokens: str | None = None, steps: int = PATH_STEPS) -> DataFrame:
    """The same by quadrature along the path; a check on the closed form."""
    return explode_scores(token_scores(docs, id, ids, vecs, weights, dim, steps), id, ids, tokens)


def padded_groups(lengths: np.ndarray, dim: int) -> list[np.ndarray]:
    """Documents with tokens in groups of like length, whose padded vectors are at most ``PADDED_NUMBERS`` numbers or one document."""
    order = np.argsort(lengths, kind="stable")
    groups, start = [], int(np.searchsorted(lengths[order], 1))
    for end in range(start + 1, len(order) + 1):
        held = (end + 1 - start) * lengths[order[end]] * dim if end < len(order) else np.inf
        # Without padding a step is much cheaper, so a group that is half full ends where the length changes.
        if held > PADDED_NUMBERS or (2 * held > PADDED_NUMBERS and lengths[order[end]] > lengths[order[end - 1]]):
            groups.append(order[start:end])
            start = end
    return groups


@cache
def path_nodes(steps: int) -> list[tuple[float, float]]:
    """Gauss-Legendre nodes between 0 and 1 with their weights; finding them takes longer than a step of a small batch."""
    at, weight = np.polynomial.legendre.leggauss(steps)
    return list(zip(((at + 1) / 2).tolist(), (weight / 2).tolist()))


def path_scores(network: Network, x: np.ndarray, mask: np.ndarray, target: np.ndarray | None, steps: int) -> tuple[np.ndarray, ...]:
    """Scores of each token, target, logits and logits at zero of a padded batch, one node of the path at a time.

    Gradients are added up over the path and multiplied with the vectors once; of one that is the same view for all tokens only that view is added.
    """
    z = np.asarray(network(x, mask, None)[0], float)
    at_zero = np.asarray(network(np.zeros_like(x), mask, None)[0], float)
    target = z.argmax(axis=1) if target is None else target
    total, at = np.zeros((len(x), 1, x.shape[2])), np.empty_like(x)
    for a, weight in path_nodes(steps):
        slope = np.asarray(network(np.multiply(x, a, out=at), mask, target)[1], float)
        if slope.shape != x.shape:
            raise ValueError(f"the gradient has shape {slope.shape}, the vectors {x.shape}")
        slope = slope[:, :1] if slope.strides[1] == 0 else slope
        total = total + weight * slope if total.shape[1] < slope.shape[1] else np.add(total, weight * slope, out=total)
    scores = (x @ total.transpose(0, 2, 1))[:, :, 0] if total.shape[1] == 1 else np.einsum("ijk,ijk->ij", x, total)
    return scores / x.shape[2], target, z, at_zero


def network_scores(docs: DataFrame, ids: str, vecs: DataFrame, network: Network, dim: int, steps: int = PATH_STEPS) -> DataFrame:
    """Add ``scores`` (one per token), ``y_pred``, ``z`` and ``z0`` (logits at zero vectors) for a network of the caller.

    ``network(x, mask, target)`` gets padded token vectors of shape (documents, tokens, ``dim``), a mask that is true at
    tokens, and None or a class for each document. It returns logits, and the gradient of the logit of that class by ``x``
    (None if there is no class). The path from zero vectors is integrated by Gauss-Legendre quadrature. The target is the class of the
    greatest logit, unless ``docs`` has a column ``y_pred``. One map without a shuffle; documents of like length meet in padded
    batches of at most ``PADDED_NUMBERS`` numbers, or one document. Documents without tokens, whose ids are empty or null, have no scores
    and null elsewhere, but for a given ``y_pred``. Tasks map the vectors from a file on their machine, however many they are.
    """
    sent = scoring.mapped_matrix(vecs, dim, bounded=False)

    def score(lists: pa.ListArray, given: np.ndarray | None) -> pa.StructArray:
        flat, lengths = ids_of(lists)
        matrix = sent.value
        places, begin = matrix.places(flat), np.cumsum(lengths) - lengths
        found, chosen, logits, zeros = np.zeros(len(flat)), [None] * len(lengths), [None] * len(lengths), [None] * len(lengths)
        if given is not None:
            chosen = [int(y) for y in given]
        for group in padded_groups(lengths, dim):
            mask = np.arange(lengths[group].max()) < lengths[group][:, None]
            at = (begin[group][:, None] + np.arange(mask.shape[1]))[mask]
            x = np.zeros((*mask.shape, dim))
            x[mask] = matrix.take(places[at])
            scores, target, z, z0 = path_scores(network, x, mask, None if given is None else given[group], steps)
            found[at] = scores[mask]
            for i, doc in enumerate(group):
                chosen[doc], logits[doc], zeros[doc] = int(target[i]), z[i].tolist(), z0[i].tolist()
        ends = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
        of_doc = [pa.array(chosen, pa.int32()), *(pa.array(v, pa.list_(pa.float64())) for v in (logits, zeros))]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(found)), *of_doc], ["scores", "y_pred", "z", "z0"])

    kind = "struct<scores:array<double>,y_pred:int,z:array<double>,z0:array<double>>"

    @F.arrow_udf(kind)
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield from parts_of(lambda part: score(part, None), lists)

    @F.arrow_udf(kind)
    def named(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, target in batches:
            yield from parts_of(lambda part, y: score(part, y.to_numpy(zero_copy_only=False).astype(np.int64)), lists, target)

    lists = F.col(ids).cast("array<int>")
    found = docs.withColumn("_scored", named(lists, F.col("y_pred").cast("int")) if "y_pred" in docs.columns else best(lists))
    kept = [c for c in docs.columns if c not in ("scores", "y_pred", "z", "z0")]
    return found.select(*kept, "_scored.scores", "_scored.y_pred", "_scored.z", "_scored.z0")


def network_completeness(scored: DataFrame, id: str, dim: int) -> DataFrame:
    """Sum of the attributions next to the gain in the logit since zero vectors; what differs is the error of the quadrature."""
    gain = F.get("z", F.col("y_pred")) - F.get("z0", F.col("y_pred"))
    return scored.where(F.size("scores") > 0).select(id, (array_sum(F.col("scores")) * dim).alias("attributed"), gain.alias("gain"))


def ig_completeness(scored: DataFrame, id: str, weights: DataFrame, dim: int, *kept: str, empty: bool = False) -> DataFrame:
    """Sum of the attributions next to the gain in the logit; they are equal. Of documents with tokens; others are null there if ``empty`` keeps them."""
    at_zero = F.get(model_column(weights), F.col("y_pred"))["b"]
    some = F.size("scores") > 0
    rows = scored if empty else scored.where(some)
    both = ((array_sum(F.col("scores")) * dim).alias("attributed"), (F.get("z", F.col("y_pred")) - at_zero).alias("gain"))
    return rows.select(id, *kept, *both) if not empty else rows.select(id, *kept, *[F.when(some, c).alias(n) for c, n in zip(both, ("attributed", "gain"))])


def _bounds(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least, median and greatest number of each list; NaN where it is empty."""
    doc = np.repeat(np.arange(len(counts)), counts)
    ordered = np.append(flat[np.lexsort((flat, doc))], np.nan)
    start = np.cumsum(counts) - counts
    some = counts > 0

    def at(place: np.ndarray) -> np.ndarray:
        return np.where(some, ordered[np.where(some, start + place, -1)], np.nan)

    return at(0 * counts), (at((counts - 1) // 2) + at(counts // 2)) / 2, at(counts - 1)


def _numbers(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float), counts


def bound_lists(scored: DataFrame) -> DataFrame:
    """Add ``low``, ``mid`` and ``high`` of the ``scores`` of each document; null without tokens."""
    def of_part(lists: pa.Array) -> pa.Array:
        each = [pa.array(b, pa.float64(), from_pandas=True) for b in _bounds(*_numbers(lists))]
        return pa.StructArray.from_arrays(each, ["low", "mid", "high"])

    @F.arrow_udf("struct<low:double,mid:double,high:double>")
    def bounds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield from parts_of(of_part, lists)

    return scored.withColumn("_bounds", bounds("scores")).select(*scored.columns, "_bounds.*")


def score_bounds(scores: DataFrame, id: str) -> DataFrame:
    """Least, median and greatest score of each document."""
    return scores.groupBy(id).agg(
        F.min("score").alias("low"), F.median("score").alias("mid"), F.max("score").alias("high")
    )


def color_of(score: Column, low: Column, mid: Column, high: Column, steps: int | None = PALETTE_STEPS) -> Column:
    """Hex colour on the red-white-green scale, linear on both sides of the median.

    ``steps`` rounds the place on the scale down to a palette of that many
    colours; None keeps it continuous. Equal scores are white.
    """
    place = (score - low) / (high - low)
    center = (mid - low) / (high - low)
    if steps:
        place = F.least(F.floor(place * steps), F.lit(steps - 1)) / F.lit(float(steps - 1))

    def channel(red: int, white: int, green: int) -> Column:
        return F.rint(
            F.when(place <= 0, F.lit(float(red)))
            .when(place >= 1, F.lit(float(green)))
            .when(place <= center, red + (white - red) * place / center)
            .otherwise(white + (green - white) * (place - center) / (1 - center))
        ).cast("int")

    shade = F.format_string("#%02x%02x%02x", *[channel(*c) for c in zip(RED, WHITE, GREEN)])
    return F.when(high > low, shade).otherwise(F.lit("#ffffff"))


def score_colors(scores: DataFrame, id: str, steps: int | None = PALETTE_STEPS) -> DataFrame:
    """Add the colour of each token within its document, to a table of token rows."""
    doc = Window.partitionBy(id)
    return (
        scores
        .withColumn("_low", F.min("score").over(doc))
        .withColumn("_mid", F.median("score").over(doc))
        .withColumn("_high", F.max("score").over(doc))
        .withColumn("color", color_of(F.col("score"), F.col("_low"), F.col("_mid"), F.col("_high"), steps))
        .drop("_low", "_mid", "_high")
    )


def shade_lists(lists: pa.ListArray, steps: int | None) -> pa.ListArray:
    """The colours of :func:`color_of` for all scores of a batch of documents."""
    flat, counts = _numbers(lists)
    low, mid, high = (np.repeat(b, counts) for b in _bounds(flat, counts))
    with np.errstate(divide="ignore", invalid="ignore"):
        place, center = (flat - low) / (high - low), (mid - low) / (high - low)
        if steps:
            place = np.minimum(np.floor(place * steps), steps - 1) / (steps - 1)
        shade = np.zeros(len(flat), np.int64)
        for red, white, green in zip(RED, WHITE, GREEN):
            channel = np.where(place <= center, red + (white - red) * place / center, white + (green - white) * (place - center) / (1 - center))
            channel = np.rint(np.where(place <= 0, red, np.where(place >= 1, green, channel)))
            shade = shade * 256 + np.where(high > low, channel, 255).astype(np.int64)
    used, which = np.unique(shade, return_inverse=True)
    names = pa.array([f"#{c:06x}" for c in used.tolist()], pa.string()).take(pa.array(which.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), names)


def color_lists(scored: DataFrame, steps: int | None = PALETTE_STEPS, out: str = "colors") -> DataFrame:
    """Add the colours of all tokens of a document from its ``scores``; nothing leaves the row."""
    @F.arrow_udf("array<string>")
    def shade(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield from parts_of(lambda part: shade_lists(part, steps), lists)

    return scored.withColumn(out, shade("scores"))


def _escape(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(raw, safe)
    return text


def marked_text(text: str, shown: list[str] | None, starts: list[int], ends: list[int], colors: list[str | None]) -> str:
    """The text with a coloured mark around each token that has a colour.

    ``shown`` stands in place of the tokens' own text; then nothing is escaped, and the last token is the end.
    """
    full = shown is None
    escape = _escape if full and any(c in text for c in '&<>"') else str
    out, at = [], 0
    for i, (start, end, color) in enumerate(zip(starts, ends, colors)):
        inner = escape(text[start:end]) if full else shown[i]
        if at < start:
            out.append(escape(text[at:start]))
        out.append(inner if color is None else f'{MARK_OPEN}{color}">{inner}{MARK_CLOSE}')
        at = end
    if full:
        out.append(escape(text[at:]))
    return "".join(out)


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Values of a batch of lists one after the other, and where each list ends; a null list is empty."""
    return lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))


def _pieces(text: pa.StringArray, cuts: np.ndarray, counts: np.ndarray) -> pa.StringArray:
    """Texts cut at places given in characters, from 0 up to the length of each; ``counts`` cuts of each text."""
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[at[0]:at[-1]]
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(heads, at[:-1] - at[0])
    places = np.append(heads, len(data))[cuts + np.repeat(first, counts)]
    return pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data))


def _escaped(pieces: pa.StringArray) -> pa.StringArray:
    raw = np.frombuffer(pieces.buffers()[2], np.uint8)
    for ch, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        if (raw == ord(ch)).any():
            pieces = pc.replace_substring(pieces, ch, safe)
    return pieces


def marked_texts(text: pa.StringArray, starts: np.ndarray, ends: np.ndarray, colors: pa.StringArray, counts: np.ndarray) -> pa.StringArray:
    """:func:`marked_text` of whole texts whose tokens, at least one each, stand in order without overlap and all have a colour."""
    lengths = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    docs, tokens = len(counts), np.arange(len(starts))
    doc = np.repeat(np.arange(docs), counts)
    # Cuts of a text: 0, then start and end of each token; its tail goes up to the first cut of the next text.
    cuts, begin = np.zeros(2 * len(starts) + docs + 1, np.int64), 2 * (np.cumsum(counts) - counts) + np.arange(docs)
    place = 2 * tokens + doc + 1
    cuts[place], cuts[place + 1] = starts, ends
    cuts[-1] = lengths[-1]
    sizes = 2 * counts + 1
    sizes[-1] += 1
    pieces = _escaped(_pieces(text, cuts, sizes))
    used = colors.dictionary_encode()
    opens = pc.binary_join_element_wise(MARK_OPEN, used.dictionary, '">', "").take(used.indices)
    shown = pc.binary_join_element_wise(
        pieces.take(pa.array(place - 1)), opens, pieces.take(pa.array(place)), MARK_CLOSE, "")
    tails = pieces.take(pa.array(begin + 2 * counts))
    first = np.concatenate(([0], np.cumsum(counts)))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), shown), "")
    return pc.binary_join_element_wise(joined, tails, "")


def _in_order(starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Texts whose tokens, at least one, lie inside them in order and without overlap."""
    doc = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate(([0], ends[:-1]))
    before[np.flatnonzero(np.diff(doc, prepend=-1))] = 0
    wrong = np.bincount(doc[(starts < before) | (ends < starts) | (ends > lengths[doc])], minlength=len(counts))
    return (wrong == 0) & (counts > 0)


def highlight_html(docs: DataFrame, colored: DataFrame, id: str, x: str, mode: str = "full") -> DataFrame:
    """One HTML string per document with a coloured mark around each token.

    ``colored`` has a row per token with ``pos`` and ``color``; a token without such a row gets no colour
    and moves no other token's. See :func:`highlight_lists`.
    """
    shades = colored.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("pos", "color"))).alias("_shades"))
    placed = docs.join(shades, id, "left").withColumn(
        "_colors", F.transform("tokens", lambda t, i: F.element_at("_shades", i)))
    return highlight_lists(placed, x, "_colors", mode).select(*docs.columns, "html")


def highlight_lists(docs: DataFrame, x: str, colors: str = "colors", mode: str = "full") -> DataFrame:
    """Add ``html`` from the text, ``tokens``, ``offsets`` and the array of colours.

    Mode ``full`` marks the original text, escapes it and keeps what follows the last token; mode
    ``reference`` marks the normalised token, escapes nothing and stops there.
    A null colour leaves the token unmarked; a null text is empty.
    Mode ``full`` cuts and joins whole batches of texts as arrays, without a Python step per token.
    """
    if mode not in ("full", "reference"):
        raise ValueError(f"unknown mode: {mode}")
    full = mode == "full"

    def one_by_one(offsets: pa.Array, text: pa.Array, shades: pa.Array, tokens: pa.Array | None = None) -> pa.Array:
        spans, span_at = _flat(offsets)
        starts, ends = (spans.field(f).to_pylist() for f in ("start", "end"))
        colored, color_at = _flat(shades)
        colored = colored.to_pylist()
        shown, shown_at = _flat(tokens) if not full else (None, None)
        shown = shown.to_pylist() if not full else None
        out = []
        for i, t in enumerate(text.to_pylist()):
            here = slice(span_at[i], span_at[i + 1])
            own = None if full else shown[shown_at[i]:shown_at[i + 1]]
            out.append("" if t is None else marked_text(t, own, starts[here], ends[here], colored[color_at[i]:color_at[i + 1]]))
        return pa.array(out, pa.string())

    def at_once(offsets: pa.Array, text: pa.Array, shades: pa.Array) -> pa.Array:
        """Texts whose tokens stand in order and all have a colour together; others by themselves."""
        spans, span_at = _flat(offsets)
        colored, color_at = _flat(shades)
        counts = np.diff(span_at)
        if spans.null_count or any(spans.field(f).null_count for f in ("start", "end")) or not len(spans):
            return one_by_one(offsets, text, shades)
        starts, ends = (spans.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "end"))
        lengths = pc.fill_null(pc.utf8_length(text), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        bare = np.concatenate(([0], np.cumsum(colored.is_null().to_numpy(zero_copy_only=False))))
        plain = _in_order(starts, ends, counts, lengths) & (np.diff(color_at) == counts) & (np.diff(bare[color_at]) == 0) & (lengths >= 0)
        some, other = pa.array(np.flatnonzero(plain)), pa.array(np.flatnonzero(~plain))
        if not len(some):
            return one_by_one(offsets, text, shades)
        own = np.repeat(plain, counts)
        marked = marked_texts(
            text.take(some), starts[own], ends[own], colored.filter(pa.array(np.repeat(plain, np.diff(color_at)))), counts[plain])
        if not len(other):
            return marked
        both = pa.concat_arrays([marked, one_by_one(offsets.take(other), text.take(other), shades.take(other))])
        return both.take(pa.array(np.argsort(np.concatenate((some, other)), kind="stable")))

    @F.arrow_udf("string")
    def marked(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, offsets, shades, *tokens in batches:  # marks take many times the bytes of the text: they leave part by part
            yield from parts_of(at_once if full else one_by_one, offsets, text, shades, *tokens)

    return docs.withColumn("html", marked(*map(F.col, (x, "offsets", colors, *([] if full else ["tokens"])))))


def explain_sample(
    c: Corpus, vocab: DataFrame, merges: DataFrame, vecs: DataFrame, weights: DataFrame, dim: int,
    n: int = 1, mode: str = "full", seed: int = 0, special=("<PAD>",), lowercase: bool = True, **filters,
) -> DataFrame:
    """Pick ``n`` documents by the filters and explain each of them.

    Gives key, predicted class (from 1), actual label and HTML.
    """
    picked = filter_load(c, n=n, seed=seed, **filters)
    docs = via_table(encode_text(picked, c.x, vocab, merges, special, lowercase), "explained")
    shown = highlight_lists(color_lists(token_scores(docs, c.id, "ids", vecs, weights, dim)), c.x, mode=mode)
    return shown.select(c.id, (F.col("y_pred") + 1).alias("pred"), F.col(c.y).alias("actual"), "html")
