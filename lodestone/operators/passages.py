"""Cutting text units into located passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_space, strip

TARGET, OVERLAP, LEAST = 1400, 220, 60
PIECE = "array<struct<at:int,end:int,text:string>>"


def paragraphs(text: Column) -> Column:
    """Cut at empty lines and at line ends after a period; trimmed, empty ones left out."""
    parts = F.split(F.replace(text, F.lit("\r"), F.lit("")), r"\n{2,}|(?<=\.)\s*\n")
    return F.filter(F.transform(parts, normalize_space), lambda p: p != "")


def packed(text: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """array<struct<at, end, text>>: paragraphs, joined by a space, packed up to the target; the next passage begins with the
    last `overlap` characters; a paragraph above the target is cut into windows. Places count in the joined paragraphs."""
    kind = f"struct<buf:string,start:int,cursor:int,out:{PIECE}>"
    start = F.from_json(F.lit('{"buf":"","start":0,"cursor":0,"out":[]}'), kind)
    piece = lambda at, body: F.array(F.struct(at.cast("int").alias("at"), (at + F.char_length(body)).cast("int").alias("end"), body.alias("text")))
    state = lambda buf, at, cursor, out: F.struct(buf.alias("buf"), at.cast("int").alias("start"), cursor.cast("int").alias("cursor"), out.alias("out"))
    step = target - overlap

    def fold(a: Column, p: Column) -> Column:
        n, m = F.char_length(p), F.char_length(a["buf"])
        after = a["cursor"] + n + 1
        flushed = F.when(m > 0, F.concat(a["out"], piece(a["start"], a["buf"]))).otherwise(a["out"])
        count = F.greatest(F.ceil((n - target) / step), F.lit(0)).cast("int")
        windows = F.transform(F.sequence(F.lit(0), count), lambda i: F.struct((a["cursor"] + i * step).cast("int").alias("at"), (a["cursor"] + i * step + F.char_length(F.substr(p, i * step + 1, F.lit(target)))).cast("int").alias("end"), F.substr(p, i * step + 1, F.lit(target)).alias("text")))
        tail = F.right(a["buf"], F.lit(overlap))
        again = F.greatest(a["cursor"] - F.char_length(tail), F.lit(0))
        return (
            F.when(n > target, state(F.lit(""), after, after, F.concat(flushed, windows)))
            .when(m == 0, state(p, a["cursor"], after, a["out"]))
            .when(m + 1 + n <= target, state(F.concat(a["buf"], F.lit(" "), p), a["start"], after, a["out"]))
            .otherwise(state(strip(F.concat(tail, F.lit(" "), p)), again, after, flushed))
        )

    return F.aggregate(paragraphs(text), start, fold, lambda a: F.when(F.char_length(a["buf"]) > 0, F.concat(a["out"], piece(a["start"], a["buf"]))).otherwise(a["out"]))


def passages(units: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(`keep`, chunk_index from 1, char_start, char_end, text); short ones go after numbering."""
    out = units.select(*keep, F.posexplode(packed(F.coalesce(F.col(text_col), F.lit(""))))).select(*keep, (F.col("pos") + 1).alias("chunk_index"), F.col("col.at").alias("char_start"), F.col("col.end").alias("char_end"), "col.text")
    return out.filter(F.char_length("text") >= LEAST)
