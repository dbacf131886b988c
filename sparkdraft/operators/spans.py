"""Assistant spans of rendered texts, and loss masks over their tokens.

All of it is per row: arrays in, arrays out, no shuffle.
"""

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.arrays import shift
from sparkdraft.functions.rows import explode_rows
from sparkdraft.functions.text import find_all, quote
from sparkdraft.operators.templates import Template, get_template
from sparkdraft.operators.tokens import TOKEN, VOCAB_SIZE, pieces, token_ids

# Terminators of the round and channel formats.
ROUND_END = ("[", r"Round \d+\] USER:")
CHANNEL_HEADER = "<|start|>assistant"
CHANNEL_USER = "<|start|>user<|message|>"

#: Elements that a Python worker turns over at a time, whatever its batch holds.
SLICE = 1 << 18
#: Characters whose tokens share a row on their way to a range join.
STRETCH = 256


def _literal(text: str) -> tuple[str, str]:
    """A literal as its first character and a pattern for the others."""
    return text[0], quote(text[1:])


def _until(*ends: tuple[str, str]) -> str:
    """Text up to the first terminator, to the end, or to a final line break.

    Runs without a terminator's first character are taken whole and nothing is
    ever given back, so the match is one fast forward walk.
    """
    firsts = "".join(quote(first) for first, _ in ends)
    others = "".join(rf"|{quote(first)}(?!{rest})" for first, rest in ends)
    return rf"(?:[^{firsts}\n]++|\n(?!\z){others})*+"


def span_pattern(header: str, end: tuple[str, str], keep_end: bool, *more: tuple[str, str]) -> str:
    r"""Gap, header and span in one match.

    ``\G`` ties each match to the one before: text after the last header is
    walked once and not tried again from every place.  ``keep_end`` takes the
    terminator into the span.  ``more`` are further terminators, which start with
    another character.
    """
    first, rest = _literal(header)
    c = quote(first)
    ends = (end, *more)
    gap = rf"(?:[^{c}]++|{c}(?!{rest}))*+"
    closing = f"(?:{'|'.join(quote(e) + r for e, r in ends)})?+" if keep_end else ""
    return rf"\G{gap}{quote(header)}{_until(*ends)}{closing}"


def template_pattern(template: str | Template, kind: str | None = None) -> tuple[str, str]:
    """``(header, pattern)`` for a template; ``kind`` overrides its own.

    ``general`` spans run up to and including the end-of-turn marker, ``round``
    spans to that marker or the next round's user mark, ``pair`` spans to just before the next
    user header, ``channels`` spans to just before the next user message.
    """
    t = get_template(template) if isinstance(template, str) else template
    if kind is None:
        kind = "channels" if t.parser_type == "openai-harmony" else t.pattern_type
    if kind == "round":
        # A text without round marks still ends its turns.
        more = (_literal(t.end_of_turn),) if t.end_of_turn else ()
        return t.assistant_header, span_pattern(t.assistant_header, ROUND_END, True, *more)
    if kind == "channels":
        return CHANNEL_HEADER, span_pattern(CHANNEL_HEADER, _literal(CHANNEL_USER), False)
    if kind == "pair":
        header = f"{t.end_of_turn or ''}{t.assistant_header}"
        user = f"{t.end_of_turn or ''}{t.user_header}"
        return header, span_pattern(header, _literal(user), False)
    if t.end_of_turn is None:
        # Without an end marker a turn lasts until the next user header.
        return t.assistant_header, span_pattern(t.assistant_header, _literal(t.user_header), False)
    return t.assistant_header, span_pattern(t.assistant_header, _literal(t.end_of_turn), True)


def span_parts(text: Column, template: str | Template, kind: str | None = None) -> Column:
    """``array<struct<gap, span>>``: the text before each header, and its span.

    A gap holds no header, so the first header found in a match divides it.
    """
    header, pattern = template_pattern(template, kind)

    def divide(whole):
        at = F.instr(whole, header)
        return F.struct(
            F.substring(whole, F.lit(1), at - 1).alias("gap"),
            F.substring(whole, at + len(header), F.length(whole)).alias("span"),
        )

    return F.transform(find_all(text, pattern), divide)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list array in one piece, and each row's length; a null row has none."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths


def _listed(values: np.ndarray, lengths: np.ndarray, like: pa.Array) -> pa.Array:
    """Rows of the given lengths again, null where ``like`` is."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()), mask=mask)


def _in_slices(work: Callable[..., pa.Array], *lists: pa.Array) -> pa.Array:
    """``work`` over slices of the rows, of about :data:`SLICE` elements of the first list array.

    A batch holds thousands of rows, and the work on it many 64-bit numbers for each
    element: over slices that memory does not grow with the batch.  A row is not cut.
    """
    lengths = pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    cuts = [0]
    while cuts[-1] < len(ends):
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + SLICE, "right"))))
    if len(cuts) <= 2:
        return work(*lists)
    return pa.concat_arrays([work(*[a.slice(i, j - i) for a in lists]) for i, j in zip(cuts, cuts[1:])])


def _sums_before(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Within each row, the sum of the elements before a place: one running sum over all."""
    before = np.cumsum(values) - values
    starts = np.cumsum(lengths) - lengths
    base = before[np.minimum(starts, max(len(before) - 1, 0))] if len(before) else np.zeros(len(starts), np.int64)
    return before - np.repeat(base, lengths)


def prefix_sums(array: Column) -> Column:
    """The sum of the elements before each place.

    Spark has no running sum over an array in linear time; this is one, over
    many rows at a time.
    """

    def sums(lists: pa.Array) -> pa.Array:
        values, lengths = _flat(lists)
        return _listed(_sums_before(values, lengths), lengths, lists)

    @F.arrow_udf("array<int>")
    def before(lists: pa.Array) -> pa.Array:
        return _in_slices(sums, lists)

    return before(array)


def assistant_spans(
    df: DataFrame, text: str, template: str | Template, kind: str | None = None, last_only: bool = False
) -> DataFrame:
    """Add ``spans``: ``array<struct<start, end, content>>``.

    Offsets count code points, from 0, end exclusive.
    """
    header, _ = template_pattern(template, kind)
    width = len(header)
    parts = df.withColumn("_p", span_parts(F.col(text), template, kind))
    widths = F.transform("_p", lambda p: F.length(p["gap"]) + width + F.length(p["span"]))
    placed = F.transform(
        F.arrays_zip(F.col("_p").alias("p"), F.col("_at").alias("at")),
        lambda x: F.struct(
            (x["at"] + F.length(x["p"]["gap"]) + width).alias("start"),
            (x["at"] + F.length(x["p"]["gap"]) + width + F.length(x["p"]["span"])).alias("end"),
            x["p"]["span"].alias("content"),
        ),
    )
    if last_only:
        placed = F.slice(placed, F.greatest(F.size("_p"), F.lit(1)), F.lit(1))
    return parts.withColumn("_at", prefix_sums(widths)).withColumn("spans", placed).drop("_p", "_at")


def segments(text: Column, parts: Column, header: str, last_only: bool = False) -> Column:
    """The whole text as ``array<struct<part, mask>>``, mask 1 inside spans.

    ``parts`` are the text's :func:`span_parts`, best given as a column of their
    own: they are used more than once.  Joined again, the segments are the text.
    """
    n = F.size(parts)

    def pair(p, i):
        inside = F.when(i == n - 1, 1).otherwise(0) if last_only else F.lit(1)
        return F.array(
            F.struct(F.concat(p["gap"], F.lit(header)).alias("part"), F.lit(0).alias("mask")),
            F.struct(p["span"].alias("part"), inside.alias("mask")),
        )

    covered = F.aggregate(
        parts,
        F.lit(0),
        lambda acc, p: acc + F.length(p["gap"]) + len(header) + F.length(p["span"]),
    )
    tail = F.substring(text, covered + 1, F.length(text))
    return F.concat(
        F.flatten(F.transform(parts, pair)),
        F.array(F.struct(tail.alias("part"), F.lit(0).alias("mask"))),
    )


def edges_part_tokens(template: str | Template, kind: str | None = None) -> bool:
    """Whether the marks of a template keep tokens from reaching over the edges of its spans.

    A token of more than one character is a run of letters and digits or a marker
    ``<|name|>``.  A span starts after the header, and ends after the end mark or
    before the mark that follows it (or before a line break, or with the text).
    """
    t = get_template(template) if isinstance(template, str) else template
    chosen = kind or ("channels" if t.parser_type == "openai-harmony" else t.pattern_type)
    header, _ = template_pattern(t, kind)
    kept = {"pair": [], "channels": []}.get(chosen, [t.end_of_turn] if t.end_of_turn else [])
    following = {"pair": [f"{t.end_of_turn or ''}{t.user_header}"], "channels": [CHANNEL_USER], "round": []}.get(
        chosen, [] if t.end_of_turn else [t.user_header]
    )
    after = all(re.search(r"[^0-9A-Za-z_<|]\Z", mark) for mark in (header, *kept))
    # A round ends with its user mark, which is kept and ends in a colon.
    return after and all(re.match(r"[^0-9A-Za-z_|>]", mark) for mark in following)


def prefix_mask(token_texts: Column, spans: Column) -> Column:
    """1 for the tokens between the token counts of the text up to a span's start and up to its end.

    The tokens whose end is not past an edge are found by one search over the ends of all
    tokens of a batch.  A token that reaches over the edge counts for as many tokens
    as its part before the edge has on its own.
    """
    whole = re.compile(TOKEN)

    def marked(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        tokens = texts.flatten()
        width = pc.utf8_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = _sums_before(width, lengths)
        stop = start + width
        first, n_spans = _flat(firsts)
        last = _flat(lasts)[0]
        wide = int(max(stop.max(initial=0), last.max(initial=0))) + 2
        ends = np.repeat(np.arange(len(lengths)), lengths) * wide + stop
        base, of = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(n_spans)), n_spans)

        def counted(edge: np.ndarray) -> np.ndarray:
            """Where the token after each edge stands among all tokens, not past its row's last."""
            at = np.searchsorted(ends, of * wide + edge, "right")
            limit = base[of] + lengths[of]
            inside = np.flatnonzero(at < limit)
            for i in inside[start[at[inside]] < edge[inside]].tolist():
                part = tokens[int(at[i])].as_py()[: int(edge[i] - start[at[i]])]
                at[i] += len(whole.findall(part))
            return np.minimum(at, limit)

        steps = np.zeros(len(width) + 1, np.int64)
        opening, closing = counted(first), counted(last)
        some = opening < closing
        np.add.at(steps, opening[some], 1)
        np.add.at(steps, closing[some], -1)
        return _listed((np.cumsum(steps)[:-1] > 0).astype(np.int32), lengths, texts)

    @F.arrow_udf("array<int>")
    def mask(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        return _in_slices(marked, texts, firsts, lasts)

    return mask(token_texts, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]))


def masked_tokens(
    df: DataFrame,
    text: str,
    template: str | Template,
    max_length: int | None = None,
    last_only: bool = False,
    kind: str | None = None,
    vocab_size: int = VOCAB_SIZE,
) -> DataFrame:
    """Add ``pieces, input_ids, loss_mask, attention_mask`` under the prefix rule.

    The pieces are those of the whole text.  A span's tokens are those between the
    token counts of the text up to its start and up to its end.  Where no token can
    reach over a span's edge, the text is cut there and each part tokenised on its
    own, which gives just these counts in one linear pass; else :func:`prefix_mask`
    finds them from the offsets of the whole text's tokens.
    """
    header, _ = template_pattern(template, kind)
    if not edges_part_tokens(template, kind):
        spanned = assistant_spans(df, text, template, kind, last_only)
        found = pieces(F.col(text))
        if max_length is not None:
            found = F.slice(found, 1, max_length)
        rows = spanned.withColumn("pieces", found)
        rows = rows.withColumn("loss_mask", prefix_mask(F.col("pieces"), F.col("spans"))).drop("spans")
        return rows.withColumn("input_ids", token_ids(F.col("pieces"), vocab_size)).withColumn(
            "attention_mask", F.array_repeat(F.lit(1), F.size("pieces"))
        )
    parted = df.withColumn("_p", span_parts(F.col(text), template, kind))
    tokenised = F.transform(
        segments(F.col(text), F.col("_p"), header, last_only),
        lambda s: F.struct(pieces(s["part"]).alias("p"), s["mask"].alias("mask")),
    )
    flat = parted.withColumn("_t", tokenised).drop("_p")
    tokens = F.flatten(F.transform("_t", lambda s: s["p"]))
    mask = F.flatten(F.transform("_t", lambda s: F.array_repeat(s["mask"], F.size(s["p"]))))
    if max_length is not None:
        tokens, mask = F.slice(tokens, 1, max_length), F.slice(mask, 1, max_length)
    done = flat.withColumn("pieces", tokens).withColumn("loss_mask", mask).drop("_t")
    return done.withColumn("input_ids", token_ids(F.col("pieces"), vocab_size)).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), F.size("pieces"))
    )


def _hits(
    start: np.ndarray, stop: np.ndarray, n_tokens: np.ndarray, first: np.ndarray, last: np.ndarray,
    n_spans: np.ndarray, contained: bool, closed_end: bool,
) -> np.ndarray:
    """Which tokens of all rows lie in a span of their own row.

    Spans are disjoint and ascending: one candidate per token decides, and one
    search finds it for all rows when places are counted on from row to row.
    """
    if not len(first):
        return np.zeros(len(start), np.int32)
    wide = int(max(stop.max(initial=0), last.max(initial=0))) + 2
    row = np.repeat(np.arange(len(n_tokens)), n_tokens)
    of = np.repeat(np.arange(len(n_spans)), n_spans)
    places = of * wide + first
    if contained:
        i = np.searchsorted(places, row * wide + start, "right") - 1
        inside = stop <= last[i]
    else:
        i = np.searchsorted(places, row * wide + stop, "left") - 1
        inside = (start <= last[i]) if closed_end else (start < last[i])
    return ((i >= 0) & (of[i] == row) & inside).astype(np.int32)


def _checked(policy: str) -> bool:
    if policy not in ("contained", "overlap"):
        raise ValueError(f"unknown policy {policy!r}")
    return policy == "contained"


def offset_mask_at(starts: Column, ends: Column, spans: Column, policy: str, closed_end: bool = True) -> Column:
    """:func:`offset_mask` for tokens given by character offsets, of any tokenizer."""
    contained = _checked(policy)

    def marked(starts: pa.Array, ends: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        start, lengths = _flat(starts)
        first, spans = _flat(firsts)
        hit = _hits(start, _flat(ends)[0], lengths, first, _flat(lasts)[0], spans, contained, closed_end)
        return _listed(hit, lengths, starts)

    @F.arrow_udf("array<int>")
    def mask(starts: pa.Array, ends: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        return _in_slices(marked, starts, ends, firsts, lasts)

    return mask(starts, ends, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]))


def offset_mask(token_texts: Column, spans: Column, policy: str, closed_end: bool = True) -> Column:
    """1 for tokens in one of the ascending spans, by character offsets.

    ``contained`` wants the token wholly inside.  ``overlap`` wants a common
    character; with ``closed_end`` a token that starts right at a span's end
    counts too.
    """
    contained = _checked(policy)

    def marked(widths: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        width, lengths = _flat(widths)
        start = _sums_before(width, lengths)
        first, spans = _flat(firsts)
        hit = _hits(start, start + width, lengths, first, _flat(lasts)[0], spans, contained, closed_end)
        return _listed(hit, lengths, widths)

    @F.arrow_udf("array<int>")
    def mask(widths: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        return _in_slices(marked, widths, firsts, lasts)

    return mask(
        F.transform(token_texts, F.length),
        F.transform(spans, lambda s: s["start"]),
        F.transform(spans, lambda s: s["end"]),
    )


def token_rows(df: DataFrame, key: str, tokens: str = "pieces", stretch: int | None = None) -> DataFrame:
    """``key, place, start, stop``: one row per token with its character offsets.

    With a ``stretch``, tokens that start within the same so many characters of a text
    share a row: ``place`` and ``start`` are those of the first, ``stop`` that of the last,
    and ``offsets`` says for each how far after the first it starts.
    """
    widths = F.transform(tokens, F.length)
    if stretch is not None:
        blocks = df.select(key, _blocks(widths, stretch).alias("_b"))
        return explode_rows(blocks, F.col("_b"), key, item="b").select(key, "b.*")
    placed = df.select(key, widths.alias("_w")).withColumn("_s", prefix_sums(F.col("_w")))
    pairs = F.arrays_zip(F.col("_w").alias("w"), F.col("_s").alias("s"))
    rows = explode_rows(placed, pairs, key, pos="place", item="t")
    return rows.select(key, "place", F.col("t.s").alias("start"), (F.col("t.s") + F.col("t.w")).alias("stop"))


def _blocks(widths: Column, stretch: int) -> Column:
    """Tokens of the given widths by the stretch they start in: ``array<struct<place, start, stop, offsets>>``."""
    if not 0 < stretch <= 1 << 15:
        raise ValueError(f"a stretch has 1 to {1 << 15} characters, not {stretch}")

    def blocks(lists: pa.Array) -> pa.Array:
        width, lengths = _flat(lists)
        start = _sums_before(width, lengths)
        row = np.repeat(np.arange(len(lengths)), lengths)
        cut = start // stretch
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cut[1:] != cut[:-1]))[: len(row)])
        ends = np.append(first[1:], len(row))[: len(first)]
        base = np.cumsum(lengths) - lengths
        offsets = (start - np.repeat(start[first], ends - first)).astype(np.int16)
        found = pa.StructArray.from_arrays(
            [
                pa.array(first - base[row[first]], pa.int32()),
                pa.array(start[first], pa.int32()),
                pa.array((start + width)[ends - 1], pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(offsets, pa.int16())),
            ],
            ["place", "start", "stop", "offsets"],
        )
        n_blocks = np.bincount(row[first], minlength=len(lengths))
        places = pa.array(np.concatenate(([0], np.cumsum(n_blocks))), pa.int32())
        return pa.ListArray.from_arrays(places, found, mask=lists.is_null() if lists.null_count else None)

    @F.arrow_udf("array<struct<place:int,start:int,stop:int,offsets:array<smallint>>>")
    def cut_up(lists: pa.Array) -> pa.Array:
        return _in_slices(blocks, lists)

    return cut_up(widths)


def tokens_in_spans(tokens: DataFrame, spans: DataFrame, key: str, width: int = STRETCH) -> DataFrame:
    """Tokens wholly inside a span of the same text, by a bucketed range join.

    ``spans`` has ``key, start, stop``, disjoint within a key.  Offsets are cut
    into buckets of ``width`` characters and a span is sent to each bucket it
    touches, so a bucket pairs at most ``width`` tokens with ``width`` spans and
    a long text is spread over its buckets.  Tokens that share rows, by a ``stretch``
    of :func:`token_rows` that divides ``width``, are shuffled so and told apart after
    the join; the result has a row per token either way.
    """
    first, last = F.floor(F.col("start") / width), F.floor(F.col("stop") / width)
    reached = spans.select(
        key, F.col("start").alias("_from"), F.col("stop").alias("_to"), F.explode(F.sequence(first, last)).alias("_bucket")
    )
    met = tokens.withColumn("_bucket", first).join(reached, [key, "_bucket"])
    columns = tokens.columns
    if "offsets" in columns:
        columns = [c for c in columns if c != "offsets"]
        others = [c for c in columns if c not in ("place", "start", "stop")]
        # A token ends where the next one starts, the last one where its row says.
        ends = F.concat(F.slice("offsets", F.lit(2), F.size("offsets")), F.array((F.col("stop") - F.col("start"))))
        pairs = F.arrays_zip(F.col("offsets").alias("s"), ends.alias("e"))
        apart = explode_rows(met, pairs, *others, "place", "start", "_from", "_to", pos="_i", item="_t")
        met = apart.select(
            *others,
            "_from",
            "_to",
            (F.col("place") + F.col("_i")).alias("place"),
            (F.col("start") + F.col("_t.s")).alias("start"),
            (F.col("start") + F.col("_t.e")).alias("stop"),
        )
    return met.filter((F.col("start") >= F.col("_from")) & (F.col("stop") <= F.col("_to"))).select(*columns)


def mask_runs(df: DataFrame, key: str, tokens: str = "pieces", mask: str = "loss_mask") -> DataFrame:
    """Runs of equal mask: ``key, mask, start, end, text`` (end exclusive).

    The run borders come from the arrays themselves, row by row.
    """
    # Arrays are walked, never indexed from a lambda: a computed column would
    # be evaluated again for every element.
    before = shift(F.col(mask), 1, F.lit(None), left=False)
    change = F.zip_with(mask, before, lambda m, b: ~m.eqNullSafe(b))
    starts = F.filter(F.transform(change, lambda c, i: F.when(c, i)), lambda i: i.isNotNull())
    staged = df.select(key, tokens, mask, starts.alias("_s"))
    ends = F.concat(F.slice("_s", F.lit(2), F.size("_s")), F.array(F.size(mask)))
    runs = F.when(F.size("_s") > 0, F.arrays_zip(F.col("_s").alias("start"), ends.alias("end")))
    return explode_rows(staged, runs, key, tokens, mask, item="r").select(
        key,
        F.get(F.col(mask), F.col("r.start")).alias("mask"),
        "r.start",
        "r.end",
        F.array_join(F.slice(tokens, F.col("r.start") + 1, F.col("r.end") - F.col("r.start")), "").alias("text"),
    )
