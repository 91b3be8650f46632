"""Exam text, as extracted from pages, to questions.

Spark has no function for the positions of all matches, so a boundary mark is set before each match and the
text is split there. White space is Unicode white space, as \\s is in the patterns' own language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.fixed import IMAGE_SHEETS
from paperloom.functions.text import cleaned, stripped
from paperloom.operators.numbering import numbered

CUT = "\x01"
#: What the exam's pages look like.
NUMBER = r"(?:^|\n)\s*(?=\d{1,2}\s*\.\s+[^\d\n])"
NUMBER_AT = r"^\s*(\d{1,2})\s*\.\s+"
PLUS_BLOCK = r"(?s)\n\s*<보\s*기\s*>\s*\n(.*?)(?=\s*①|\s*\z)"
CHOICE = r"(?s)([①②③④⑤]\s*.+?)(?=[①②③④⑤]|\z)"
HEADER = r"\[(\d{1,2})[～~](\d{1,2})\]\s*다음\s*(?:글을|을)\s*읽고\s*물음에\s*답하시오"
ANSWER = r"(\d{1,2})\s+([①②③④⑤])\s+\d"
CIRCLED, PLAIN = "①②③④⑤", "12345"
EVEN_FORM = "짝수형"
PAGE_ARTIFACTS = (
    r"^\s*\d{1,2}\s*$", r"홀수형|짝수형", r"이\s*문제지에\s*관한\s*저작권[^\n]*", r"한국교육과정평가원[^\n]*",
    r"\d{4}학년도\s*대학수학능력시험\s*문제지", r"제\s*\d+\s*교시", r"수학능력시험\s*문제지",
)
QUESTION_STARTS = (
    r"에\s*대한\s*설명으로", r"에\s*들어갈\s*내용으로", r"에\s*해당하는\s*것은", r"시기\s*사이에\s*있었던", r"으로\s*가장\s*적절한", r"으로\s*옳은\s*것은",
    r"옳은\s*것은", r"옳지\s*않은\s*것은", r"의\s*활동으로", r"밑줄\s*친", r"탐구\s*활동으로", r"배경으로\s*가장",
)
LAST_COMMON, LEAST_PASSAGE = 34, 20


def without_artifacts(page: Column) -> Column:
    return F.regexp_replace(page, "(?Um)" + "|".join(PAGE_ARTIFACTS), "")


def joined_pages(pages: DataFrame, stop_at_even: bool = False) -> DataFrame:
    """doc, text of pages(doc, page, text); with stop_at_even nothing from the first even-form page on."""
    rows = pages
    if stop_at_even:
        stop = pages.filter(F.contains("text", F.lit(EVEN_FORM))).groupBy("doc").agg(F.min("page").alias("_stop"))
        rows = pages.join(stop, "doc", "left").filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop")))
    parts = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("x"))
    return parts.select("doc", F.array_join(F.transform("x", lambda p: without_artifacts(p["text"])), "\n").alias("text"))


def questions(texts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc, q_num, q_text of texts(doc, text). A block whose number isn't above all before it belongs to the block before."""
    keep = ["doc", *(extra or [])]
    pieces = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), f"(?Um){NUMBER}", CUT), CUT)
    blocks = texts.select(*keep, F.posexplode(pieces).alias("pos", "piece"))
    blocks = blocks.withColumn("num", F.regexp_extract("piece", f"(?U){NUMBER_AT}", 1)).filter("num != '' and pos > 0").withColumn("num", F.col("num").cast("int"))
    before = Window.partitionBy(*keep).orderBy("pos")
    top = F.max("num").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opened = blocks.withColumn("_new", (top.isNull() | (F.col("num") > top)).cast("int")).withColumn("_group", F.sum("_new").over(before))
    merged = opened.groupBy(*keep, "_group").agg(F.array_sort(F.collect_list(F.struct("pos", "num", "piece"))).alias("x"))
    return merged.select(*keep, F.col("x")[0]["num"].alias("q_num"), F.array_join(F.transform("x", lambda p: stripped(p["piece"])), "\n").alias("q_text"))


def with_parts(blocks: DataFrame) -> DataFrame:
    """blocks with question, choices and question_plus of q_text."""
    plus = F.regexp_extract("q_text", f"(?U){PLUS_BLOCK}", 1)
    main = F.regexp_replace("q_text", f"(?U){PLUS_BLOCK}", "")
    first = F.regexp_extract(F.col("_main"), r"(?s)^(.*?)[①②③④⑤]", 1)
    has = F.col("_main").rlike(f"[{CIRCLED}]")
    question = F.when(has, first).otherwise(F.col("_main"))
    found = F.transform(F.regexp_extract_all("_main", F.lit(f"(?U){CHOICE}"), F.lit(1)), lambda c: cleaned(F.regexp_replace(c, r"(?U)^([①②③④⑤])\s*", "$1 ")))
    return blocks.withColumn("_main", main).withColumns({
        "question": cleaned(F.regexp_replace(stripped(question), r"(?U)^\d{1,2}\s*\.\s*", "")),
        "choices": F.filter(found, lambda c: c != ""),
        "question_plus": cleaned(plus),
    }).drop("_main")


def answer_sheet(sheets: DataFrame) -> DataFrame:
    """doc, q_num, answer of sheets(doc, text); the first answer of a number counts."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(f"(?U){ANSWER}"), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(f"(?U){ANSWER}"), F.lit(2)).alias("a"))
    rows = sheets.select("doc", F.posexplode(pairs).alias("pos", "p")).select("doc", "pos", F.col("p.n").cast("int").alias("q_num"), F.translate("p.a", CIRCLED, PLAIN).alias("answer"))
    return rows.groupBy("doc", "q_num").agg(F.min_by("answer", "pos").alias("answer"))


def image_sheet(spark: SparkSession, subject: str, year: int) -> DataFrame:
    """q_num, answer of an exam whose answer sheet is an image."""
    return spark.createDataFrame(sorted(IMAGE_SHEETS[subject, year].items()), "q_num int, answer string")


def passages(texts: DataFrame) -> DataFrame:
    """doc, q_from, q_to, segment: the text after each [N~M] header up to the next; headers from 35 on and repeated ranges are left out."""
    parts = F.split(F.regexp_replace("text", f"(?U)(?={HEADER})", CUT), CUT)
    rows = texts.select("doc", F.posexplode(parts).alias("pos", "piece")).withColumns({
        "q_from": F.regexp_extract("piece", f"(?U)^{HEADER}", 1), "q_to": F.regexp_extract("piece", f"(?U)^{HEADER}", 2),
    }).filter("q_from != ''")
    rows = rows.withColumns({"q_from": F.col("q_from").cast("int"), "q_to": F.col("q_to").cast("int"), "segment": F.regexp_replace("piece", f"(?U)^{HEADER}", "")})
    first = rows.filter(F.col("q_from") <= LAST_COMMON).groupBy("doc", "q_from", "q_to").agg(F.min_by("segment", "pos").alias("segment"))
    return first


def language_exam(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """doc, q_num, paragraph, question, choices, question_plus, answer of a language exam. answers(doc, q_num, answer)."""
    starts = F.concat(F.lit(r"(?Us)^(.*?)(?:^|\n)\s*"), F.col("q_from").cast("string"), F.lit(r"\s*\.\s+.*$"))
    found = F.regexp_like("segment", starts)
    passage = F.when(found, F.call_function("regexp_extract", F.col("segment"), starts, F.lit(1))).otherwise(F.expr("substring(segment, 1, cast(floor(length(segment) / 2) AS INT))"))
    rows = passages(texts).withColumn("_p", passage)
    rows = rows.withColumns({"paragraph": cleaned(F.col("_p")), "text": F.when(found, F.expr("substring(segment, length(_p) + 1)")).otherwise(F.col("segment"))}).filter(F.length("paragraph") >= LEAST_PASSAGE)
    parsed = with_parts(questions(rows, ["q_from", "q_to", "paragraph"])).filter(F.col("q_num").between(F.col("q_from"), F.least("q_to", F.lit(LAST_COMMON)))).filter(F.size("choices") > 0)
    return parsed.join(answers, ["doc", "q_num"], "left").select("doc", "q_num", "paragraph", "question", "choices", "question_plus", F.coalesce("answer", F.lit("")).alias("answer"))


def history_passage(q_text: Column, question: Column) -> Column:
    """What stands before the question's own sentence, up to the last full stop; else the question."""
    text = F.regexp_replace(stripped(q_text), r"(?U)^\d{1,2}\s*\.\s*", "")
    head = F.regexp_extract(text, "(?Us)^(.*?)(?:" + "|".join(QUESTION_STARTS) + ")", 1)
    passage = F.regexp_extract(head, r"(?s)^(.*\.)", 1)
    return F.when((F.length(passage) > 6) & (F.length(cleaned(passage)) > 5), cleaned(passage)).otherwise(cleaned(question))


def history_exam(texts: DataFrame, answers: DataFrame, last: int = 20) -> DataFrame:
    """doc, q_num, paragraph, question, choices, question_plus, answer of a history exam."""
    blocks = questions(texts).filter(F.col("q_num").between(1, last))
    parsed = with_parts(blocks).filter(F.size("choices") > 0)
    out = parsed.join(answers, ["doc", "q_num"], "left").withColumn("paragraph", history_passage(F.col("q_text"), F.col("question")))
    return out.select("doc", "q_num", "paragraph", "question", "choices", "question_plus", F.coalesce("answer", F.lit("")).alias("answer"))


def appended(exams: list[DataFrame]) -> DataFrame:
    """The rows of several exams in one table, with the exam's number in the list as file."""
    out = None
    for k, rows in enumerate(exams):
        part = rows.withColumn("file", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def with_ids(rows: DataFrame, prefix: str = "generation-for-nlp-", start: int = 0, order: tuple[str, ...] = ("doc", "q_num"), width: int = 0) -> DataFrame:
    """rows with id, numbered densely from start in a stated order, without bringing them into one task."""
    counted = numbered(rows, list(order), "_n", start)
    digits = F.col("_n").cast("string")
    return counted.withColumn("id", F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")) if width else digits)).drop("_n")
