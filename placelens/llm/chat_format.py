"""Chat formatting by perspective rotation. Built-in expressions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placelens.llm.storage import staged

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
NARRATORS = ("system",)


def _safe(text: Column) -> Column:
    """Text in which no marker can be read as a turn border: a space parts each '<|'."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate_perspectives(
    turns: DataFrame,
    narrators: tuple[str, ...] = NARRATORS,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    block_turns: int = 1024,
) -> DataFrame:
    """Renders every dialogue once from the view of each of its participants.

    For a participant, own turns get the role ``assistant``; those of others the
    role ``user`` with the speaker's name; those of ``narrators`` stay ``system``
    and are no one's view. One row per view and turn, so no row or task holds a
    whole dialogue however long it is: conv_id, perspective, turn, seq (0-based
    place in the dialogue), chat_role, speaker, rendered (marker, body and end
    marker), masked_chars (leading characters that are no target), target_chars
    (characters to learn: body and end marker of the assistant's turns, else 0),
    char_start (where the turn begins in the whole rendering). Joined in ``seq``
    order the rows are the rendering, with its mask.

    A null text is empty; a null speaker is ``unknown``; a null conv_id is one
    dialogue of its own; turns with equal numbers (a null number comes first) follow
    speaker, then text; repeated rows are turns of their own. A dialogue that only
    narrators speak in gives no rows, and an empty table gives an empty result.
    Markers inside texts are broken by a space. Extra columns are left out.
    """
    speaker = F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        _safe(speaker).alias("speaker"),
        _safe(F.col(text_col)).alias("text"),
    )
    # A dialogue may be long: places are counted in blocks of turn numbers, then added up.
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(-1.0)) / block_turns).cast("long"))
    keyed = Window.partitionBy("conv_id", "block")
    rows = staged(rows.withColumn("at", F.row_number().over(keyed.orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")) - 1), "turns")

    is_narrator = F.col("speaker").isin(*narrators)
    people = rows.where(~is_narrator).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    sides = rows.join(people.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(is_narrator, "system").when(own, "assistant").otherwise("user")
    name = F.when((role == "user"), F.concat(F.lit(" name="), F.col("speaker"))).otherwise("")
    head = F.concat(F.lit(START), role, name, F.lit(MIDDLE))
    sides = sides.withColumns({"chat_role": role, "head": head})
    body = F.concat("text", F.lit(END))
    sides = sides.withColumns({
        "rendered": F.concat("head", body),
        "target_chars": F.when(F.col("chat_role") == "assistant", F.length(body)).otherwise(0).cast("long"),
    })
    sides = sides.withColumn("n", F.length("rendered").cast("long"))

    blocks = sides.groupBy("conv_id", "perspective", "block").agg(F.sum("n").alias("chars"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"),
        F.col("perspective").alias("_view"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
    )
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sides = sides.withColumn("chars_in_block", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_view")) & (F.col("block") == F.col("_block"))
    return sides.join(blocks, same).select(
        "conv_id",
        "perspective",
        "turn",
        (F.col("turns_before") + F.col("at")).cast("long").alias("seq"),
        "chat_role",
        "speaker",
        "rendered",
        (F.col("n") - F.col("target_chars")).alias("masked_chars"),
        "target_chars",
        (F.col("chars_before") + F.col("chars_in_block")).cast("long").alias("char_start"),
    )
