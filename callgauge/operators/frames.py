"""Provider wire formats: captured bytes to typed chunk rows.

A capture is a series of network pieces per call. Server-sent events are lines
that start with ``data: ``; a blank line ends a frame, and what follows the last
blank line is unfinished and does not count. So a line counts if it comes before
the last blank line of its call, and no frame ever has to be built.

Captures are read once, whatever providers and failures they hold. Lines are put
together and parsed once, packed by (call, block) and shuffled in that form; from
there what ends a call and the lines themselves are both taken.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgauge.functions.text import error_text
from callgauge.operators.ordered import block_of, blocks_up_to, in_order

DATA = "data: "
END_OF_STREAM = "[DONE]"
BYTES = "ISO-8859-1"  # one character per byte, so text functions work on raw bytes

CHUNK_COLUMNS = ("call_id", "seq", "ts", "type", "content", "input_tokens", "output_tokens", "error_msg")
CHUNKS_PER_LINE = 4

#: A call's pieces of one kind. ``_status`` is the HTTP status of a refused request, else ANSWERED.
CALL = ["call_id", "_provider", "_status"]
ANSWERED = -1
#: Pieces that travel together: 2^10, of a network packet each some 1.5 MB.
PIECE_BITS = 10


class Rules(NamedTuple):
    """How a provider's lines are read; the columns see data, json, failure."""

    #: What a line gives; NULL for nothing.
    out: Column
    #: Does the line end the call?
    stop: Column
    #: Does the line end the call unless a blank line follows?
    stop_inside: Column | None = None
    #: Does the line that ends the call count itself?
    stop_counts: bool = True
    drop_returns: bool = False


def _text(latin: Column) -> Column:
    """Bytes to text; invalid UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(F.encode(latin, BYTES).cast("string"))


def _by_provider(rules: dict[str, Rules], column: Callable[[Rules], Column]) -> Column:
    """The rule of the row's provider; with one rule there is no question."""
    every = list(rules.items())
    out = column(every[-1][1])
    for name, rule in reversed(every[:-1]):
        out = F.when(F.col("_provider") == name, column(rule)).otherwise(out)
    return out


def _pieces(captures: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    provider = F.col("provider") if len(rules) > 1 else F.lit(next(iter(rules)))
    refused = F.coalesce(~F.col("http_status").between(200, 299), F.lit(False))
    failure = F.col("transport_error") if "transport_error" in captures.columns else F.lit(None).cast("string")
    pieces = captures.select(
        "call_id",
        provider.alias("_provider"),
        F.when(refused, F.col("http_status").cast("int")).otherwise(F.lit(ANSWERED)).alias("_status"),
        "piece",
        "ts",
        F.when(~refused, failure).alias("failure"),
        F.coalesce(F.decode("raw", BYTES), F.lit("")).alias("bytes"),
    )
    returns = F.lit(False) if not any(r.drop_returns for r in rules.values()) else _by_provider(rules, lambda r: F.lit(r.drop_returns))
    plain = F.replace("bytes", F.lit("\r"), F.lit(""))
    return pieces.withColumn("bytes", F.when(returns & (F.col("_status") == ANSWERED), plain).otherwise(F.col("bytes")))


def _breaks() -> Column:
    return (F.length("bytes") - F.length(F.replace("bytes", F.lit("\n"), F.lit("")))).cast("bigint")


def _fragments(pieces: DataFrame) -> DataFrame:
    """Parts of lines, from pieces that know the line they start in (``_first``)."""
    return (
        pieces.withColumn("_split", F.split("bytes", "\n"))
        .select(*CALL, "piece", "ts", "failure", "_first", F.size("_split").alias("_n"), F.posexplode("_split").alias("_pos", "bytes"))
        .select(
            *CALL,
            "piece",
            "ts",
            "failure",
            (F.col("_first") + F.col("_pos")).alias("line"),
            (F.col("_pos") < F.col("_n") - 1).alias("_ended"),
            "bytes",
        )
    )


EARLIER = (Window.unboundedPreceding, -1)


def _met(rows: DataFrame, own: DataFrame, block: str) -> DataFrame:
    """Rows next to the one row that ``own``, made from them, has for their (call, block).

    Null-safe, so that no filter goes down one side alone: both then read one shuffle.
    """
    keys = [*CALL, block]
    other = own.select(*[F.col(k).alias(f"_own_{k}") for k in keys], *[c for c in own.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys]
    return rows.join(other, same).drop(*[f"_own_{k}" for k in keys])


def call_lines(captures: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """Lines of calls, numbered from 0, by (call, block): line, ts, text, ended, failure.

    A line may start in one piece and end in a later one. Pieces are numbered by the
    line breaks before them, and fragments meet by line. Line breaks are counted within
    blocks of pieces and carried over as one sum per block; lines are spread by
    (call, block).
    """
    pieces = _pieces(captures, rules).withColumn("_block", F.shiftright("piece", PIECE_BITS))
    piece = F.struct("piece", "ts", "failure", "bytes", _breaks().alias("breaks"))
    held = pieces.groupBy(*CALL, "_block").agg(F.collect_list(piece).alias("_held"))  # shuffled once, for both uses below
    breaks = F.aggregate("_held", F.lit(0).cast("bigint"), lambda n, p: n + p["breaks"])
    earlier = Window.partitionBy(*CALL).orderBy("_block").rowsBetween(*EARLIER)
    carried = held.select(*CALL, "_block", breaks.alias("_breaks")).withColumn("_carried", F.coalesce(F.sum("_breaks").over(earlier), F.lit(0)))
    in_block = Window.partitionBy(*CALL, "_block").orderBy("piece").rowsBetween(*EARLIER)
    numbered = (
        _met(held, carried.drop("_breaks"), "_block")
        .select(*CALL, "_block", "_carried", F.inline_outer("_held"))
        .withColumn("_first", F.col("_carried") + F.coalesce(F.sum("breaks").over(in_block), F.lit(0)))
    )
    fragments = _fragments(numbered).withColumn("block", block_of("line"))
    return fragments.repartition("call_id", "block").groupBy(*CALL, "block", "line").agg(
        F.max("ts").alias("ts"),
        _text(in_order("piece", "bytes")).alias("text"),
        F.max("_ended").alias("ended"),
        F.max("failure").alias("failure"),
    )


def packed_lines(captures: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """One row per (call, block) with its lines in order, each with what it gives.

    This is shuffled as it is: both what ends a call and the lines are taken from it, and
    nothing before it is done twice.
    """
    has_data = F.startswith("text", F.lit(DATA)) & F.col("failure").isNull() & (F.col("_status") == ANSWERED)
    lines = call_lines(captures, rules).withColumn("data", F.when(has_data, F.substr("text", F.lit(len(DATA) + 1))))
    line = F.struct(
        "line",
        "ts",
        (F.col("ended") & (F.col("text") == "")).alias("blank"),
        F.col("failure").isNotNull().alias("broke"),
        F.coalesce(_by_provider(rules, lambda r: r.stop), F.lit(False)).alias("stop"),
        F.coalesce(_by_provider(rules, lambda r: F.lit(False) if r.stop_inside is None else r.stop_inside), F.lit(False)).alias("stop_inside"),
        F.when(F.col("data").isNotNull() | F.col("failure").isNotNull(), _by_provider(rules, lambda r: r.out)).alias("out"),
        F.when(F.col("_status") != ANSWERED, F.col("text")).alias("body"),
    )
    keys = [*CALL, "block"]
    packed = with_json(lines).groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return packed.repartition(*keys)


def _where(condition: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter("lines", condition), lambda r: r["line"])


def _limits(packed: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """By (call, block): the last blank line of the call and the line that ends it. Blocks after
    what counts of a call have no row."""

    def goes_on(line: Column, at: Column) -> Column:
        follower = F.get("lines", at + 1)
        return line["stop"] | (line["stop_inside"] & follower.isNotNull() & ~follower["blank"])

    last = F.element_at("lines", -1)
    stops = F.filter(F.transform("lines", lambda r, at: F.when(goes_on(r, at), r["line"])), lambda n: n.isNotNull())
    blocks = packed.select(
        *CALL,
        "block",
        F.array_max(_where(lambda r: r["blank"])).alias("_blank"),
        F.array_max(_where(lambda r: r["broke"])).alias("_broke"),
        F.array_min(stops).alias("_stop"),
        F.when(last["stop_inside"] & ~last["stop"], last["line"]).alias("_open"),
        F.get("lines", F.lit(0))["blank"].alias("_starts_blank"),
    )
    following = F.lead("_starts_blank").over(Window.partitionBy(*CALL).orderBy("block"))
    settled = blocks.withColumn("_stop", F.least("_stop", F.when(~following, F.col("_open"))))
    return (
        settled.groupBy(*CALL)
        .agg(F.max("_blank").alias("_blank"), F.min("_stop").alias("_stop"), F.max("_broke").alias("_broke"))
        .withColumn("_last", F.least(F.greatest("_blank", "_broke"), "_stop"))
        .filter(F.col("_last").isNotNull())
        .select(*CALL, "_blank", "_stop", blocks_up_to("_last").alias("block"))
    )


def counted_lines(packed: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """(call_id, line, ts, out) of the lines that count and give something.

    A line counts up to the last blank line of its call and up to the line that ends it. A
    connection that broke before counts where it broke.
    """
    line = F.col("r.line")
    within = F.when(_by_provider(rules, lambda r: F.lit(r.stop_counts)), line <= F.col("_stop")).otherwise(line < F.col("_stop"))
    counts = (F.col("_stop").isNull() | within) & (F.col("r.broke") | (line <= F.col("_blank")))
    rows = _met(packed, _limits(packed, rules), "block").select(*CALL, "_blank", "_stop", F.explode_outer("lines").alias("r"))
    return rows.filter(counts & F.col("r.out").isNotNull()).select("call_id", "r.line", "r.ts", "r.out")


def _part(path: str) -> Column:
    return F.try_variant_get("json", path, "variant")


def _string_at(path: str) -> Column:
    """The value at ``path`` if it is a JSON string; never a number turned into one."""
    return F.when(F.schema_of_variant(_part(path)) == "STRING", F.try_variant_get("json", path, "string"))


def _count_at(path: str) -> Column:
    """The value at ``path`` if it is a JSON integer, wrapped to 32 bits."""
    whole = F.when(F.schema_of_variant(_part(path)) == "BIGINT", F.try_variant_get("json", path, "bigint"))
    return F.shiftright(F.shiftleft(whole, 32), 32).cast("int")


def _chunk(
    order: int,
    kind: str,
    content: Column | None = None,
    input_tokens: Column | None = None,
    output_tokens: Column | None = None,
    error_msg: Column | None = None,
) -> Column:
    def value(column: Column | None, of_type: str) -> Column:
        return (F.lit(None) if column is None else column).cast(of_type)

    return F.struct(
        F.lit(order).alias("order"),
        F.lit(kind).alias("type"),
        value(content, "string").alias("content"),
        value(input_tokens, "int").alias("input_tokens"),
        value(output_tokens, "int").alias("output_tokens"),
        value(error_msg, "string").alias("error_msg"),
    )


def _malformed(detail: Column | str) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return error_text(F.lit("malformed"), detail, F.lit(None))


def _broken_connection() -> Column:
    text = error_text(F.lit("http"), F.col("failure"), F.lit(None))
    return F.when(F.col("failure").isNotNull(), _chunk(3, "error", error_msg=text))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("call_id", "line", "ts", F.explode("out").alias("c")).select(
        "call_id",
        (F.col("line") * CHUNKS_PER_LINE + F.col("c.order")).alias("seq"),
        "ts",
        "c.type",
        "c.content",
        "c.input_tokens",
        "c.output_tokens",
        "c.error_msg",
    )


def _refused(packed: DataFrame) -> DataFrame:
    """One call_error chunk per call whose HTTP status is not 2xx, with its whole body."""
    part = F.struct(
        "block",
        F.array_join(F.transform("lines", lambda r: r["body"]), "\n").alias("body"),
        F.array_max(F.transform("lines", lambda r: r["ts"])).alias("ts"),
    )
    has_body = F.get("lines", F.lit(0))["body"].isNotNull()
    # Told apart after the shuffle that the lines take too, which a plain filter would go below.
    parts = packed.select(*CALL, F.explode_outer(F.when(has_body, F.array(part))).alias("part")).filter(F.col("part").isNotNull())
    body = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["body"]), "\n")
    return parts.groupBy(*CALL).agg(body.alias("_body"), F.max("part.ts").alias("ts")).select(
        "call_id",
        F.lit(0).cast("bigint").alias("seq"),
        "ts",
        F.lit("call_error").alias("type"),
        F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("int").alias("input_tokens"),
        F.lit(None).cast("int").alias("output_tokens"),
        error_text(F.lit("api"), F.col("_body"), F.col("_status")).alias("error_msg"),
    )


def _frames(captures: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    packed = packed_lines(captures, rules)
    return _exploded(counted_lines(packed, rules)).unionByName(_refused(packed))


def with_json(lines: DataFrame) -> DataFrame:
    """Adds ``json``: the data as a variant, NULL unless it is exactly one JSON value.

    The parser stops after the first value and does not look at the rest. As the
    only element of an array and as the only field of an object, both at once, a
    text parses to its end.
    """
    element = F.try_parse_json(F.concat(F.lit("["), F.col("data"), F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"v":'), F.col("data"), F.lit("}")))
    only = field.isNotNull() & F.try_variant_get("_element", "$[1]", "variant").isNull()
    return (
        lines.withColumn("_element", element)
        .withColumn("json", F.when(only, F.try_variant_get("_element", "$[0]", "variant")))
        .drop("_element")
    )


def openai_rules() -> Rules:
    """[DONE] ends a call. A return before the line feed is not part of a line, but for the last
    line of a frame, which is cut off before its line feed."""
    usage = _part("$.usage")
    has_usage = usage.isNotNull() & ~F.is_variant_null(usage)
    token = _string_at("$.choices[0].delta.content")
    chunk = (
        _broken_connection()
        .when(F.col("json").isNull(), _chunk(2, "error", error_msg=_malformed("invalid JSON")))
        .when(
            has_usage,
            _chunk(
                1,
                "done",
                input_tokens=_count_at("$.usage.prompt_tokens"),
                output_tokens=_count_at("$.usage.completion_tokens"),
            ),
        )
        .when(token.isNotNull(), _chunk(0, "token", content=token))
    )
    data = F.col("data")
    return Rules(F.array_compact(F.array(chunk)), data == END_OF_STREAM, data == END_OF_STREAM + "\r", stop_counts=False)


def gemini_rules() -> Rules:
    """An embedded error ends a call. One line may give a token, the end of the call and an
    error, in this order."""
    failure = _part("$.error")
    token = _string_at("$.candidates[0].content.parts[0].text")
    finished = _string_at("$.candidates[0].finishReason").isNotNull() & _part("$.usageMetadata").isNotNull()
    message = F.coalesce(_string_at("$.error.message"), F.lit("unknown gemini error"))
    chunks = [
        F.when(token != "", _chunk(0, "token", content=token)),
        F.when(
            finished,
            _chunk(
                1,
                "done",
                input_tokens=_count_at("$.usageMetadata.promptTokenCount"),
                output_tokens=_count_at("$.usageMetadata.candidatesTokenCount"),
            ),
        ),
        _broken_connection()
        .when(F.col("json").isNull(), _chunk(2, "error", error_msg=_malformed("invalid JSON")))
        .when(failure.isNotNull(), _chunk(2, "error", error_msg=_malformed(message))),
    ]
    return Rules(F.array_compact(F.array(*chunks)), failure.isNotNull(), drop_returns=True)


# One entry per provider.
RULES: dict[str, Callable[[], Rules]] = {"openai": openai_rules, "gemini": gemini_rules}


def frames_openai(captures: DataFrame) -> DataFrame:
    """OpenAI captures to chunk rows."""
    return _frames(captures, {"openai": openai_rules()})


def frames_gemini(captures: DataFrame) -> DataFrame:
    """Gemini captures to chunk rows."""
    return _frames(captures, {"gemini": gemini_rules()})


PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"openai": frames_openai, "gemini": frames_gemini}


def frames(captures: DataFrame) -> DataFrame:
    """Chunk rows of captures from several providers, in one pass; other providers are left out."""
    return _frames(captures.filter(F.col("provider").isin(*RULES)), {name: rules() for name, rules in RULES.items()})
