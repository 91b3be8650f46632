"""Chat transcripts: roles recovered by a hidden Markov model, then rendered as canonical turns.

A transcript is a list of text rows without roles. Its lines are what the model sees: the speaker marker at
the line's start, the line's length, how it begins and ends, and whether a blank line stands before. States are the roles, each as a turn's first
line or a further one. Transitions and emissions are counted on conversations whose roles are known, with
one added to each count. Viterbi finds the likeliest states, and each recovered turn, its marker removed, is
rendered as ``<|im_start|>role\\ntext<|im_end|>``.

A conversation's rows are numbered by a sort over ranges of (conversation, turn, hash of the text), and cut into
blocks of BLOCK_ROWS rows, whatever their turn numbers are. Each block of a longer one gives the best
scores from each state before it to each state at its end, a small matrix; matrices of blocks multiply (in
max and plus) like those of lines, level by level, and then the states at all borders are read off. So no
task holds more than a block's rows or BLOCK_ROWS matrices, however long a conversation is.

Defined cases: rows follow each other by turn, those of one turn number by a hash of their text; a null turn comes
first and stays null; repeated rows are each a row; a row without conversation is one of its own; null and blank
texts have no lines and give no turn; a null or unknown role is not learned from, and without any known role all moves
and features are equally likely; a text of any length is read whole; an empty table gives no turns; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paperloom.llm.common import bound_batches, decoded, stored, work_dir

ROLES = ("system", "user", "assistant")
BLOCK_ROWS = 64
FOLDS = 5
#: Speaker markers and the class of each.
MARKERS = {
    "system": 1, "context": 1, "instructions": 1, "user": 2, "human": 2, "q": 2, "question": 2, "prompter": 2,
    "assistant": 3, "ai": 3, "a": 3, "answer": 3, "bot": 3, "model": 3,
}
MARKER = regex.compile(r"\s*(?:[#*\[<]{0,3})([\p{L}]{1,12})(?:[\]>*]{0,2}):\s?")
#: Values of each feature: marker class (4: an unknown one), length, beginning, end, blank line before.
SIZES = (5, 10, 4, 4, 2)
STATES = 2 * len(ROLES)  # state = 2 * role + (1 on a further line)
START = STATES
#: What stands before the id of a conversation in its key.
NAMED = "="
#: What a block ends in, in training, where its last role is unknown.
UNKNOWN = -1


def features(line: str, blank: bool) -> tuple[tuple[int, ...], int]:
    """A line's features, and how many characters its marker takes."""
    found = MARKER.match(line)
    kind = MARKERS.get(found[1].lower(), 4) if found else 0
    cut = found.end() if kind in (1, 2, 3) else 0
    body = line[cut:].strip()
    begin = 0 if not body else 1 if body[0].isupper() else 2 if body[0].isalpha() else 3
    end = 0 if not body else 1 if body[-1] == "?" else 2 if body[-1] in ".!" else 3
    return (kind, min(len(body).bit_length(), SIZES[1] - 1), begin, end, int(blank)), cut


def lines_of(raw: bytes | None) -> list[tuple[str, bool]]:
    """The lines that aren't blank, and whether a blank one stands before."""
    out, blank = [], False
    for x in decoded(raw).split("\n"):
        if x.strip():
            out.append((x, blank))
        blank = not x.strip()
    return out


class Model:
    """Log probabilities: moves[from, to], with START as a further state before, and one table for each feature."""

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        moves = np.ones((STATES + 1, STATES))
        seen = [np.ones((STATES, n)) for n in SIZES]
        for (table, i, j), n in counts.items():
            (moves if table == "move" else seen[int(table)])[i, j] += n
        # a further line belongs to the turn before it
        for i in range(STATES + 1):
            for j in range(1, STATES, 2):
                if i == START or i // 2 != j // 2:
                    moves[i, j] = 0.0
        with np.errstate(divide="ignore"):
            self.moves = np.log(moves / moves.sum(1, keepdims=True))
        self.seen = [np.log(x / x.sum(1, keepdims=True)) for x in seen]

    def emissions(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        x = np.array(rows, int).reshape(-1, len(SIZES))
        return sum(t[:, x[:, k]].T for k, t in enumerate(self.seen))

    def passage(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        """The best score from each state before some lines (or START) to each state at their end."""
        best = np.full((STATES + 1, STATES + 1), -np.inf)
        np.fill_diagonal(best, 0.0)
        for e in self.emissions(rows):
            step = (best[:, :, None] + self.moves[None, :, :]).max(1) + e
            best = np.concatenate([step, np.full((STATES + 1, 1), -np.inf)], axis=1)
        return best

    def states(self, rows: list[tuple[int, ...]], before: int, after: int) -> list[int]:
        """The likeliest states between two known ones; after is -1 where it is open."""
        score, back = np.full(STATES + 1, -np.inf), []
        score[before] = 0.0
        for e in self.emissions(rows):
            every = score[:, None] + self.moves
            back.append(every.argmax(0))
            score = np.append(every.max(0) + e, -np.inf)
        out = [int(score.argmax()) if after < 0 else after]
        for came in reversed(back[1:]):
            out.append(int(came[out[-1]]))
        return out[::-1] if rows else []


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The passage through one part and then another."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def borders(passages: list[np.ndarray], before: int, after: int) -> list[tuple[int, int]]:
    """For each of some parts in a row, the states before and after it; after is -1 where the end is open."""
    score, back = np.full(STATES + 1, -np.inf), []
    score[before] = 0.0
    for p in passages:
        every = score[:, None] + p
        back.append(every.argmax(0))
        score = every.max(0)
    at, out = int(score.argmax()) if after < 0 else after, []
    for came in reversed(back):
        out.append((int(came[at]), at))
        at = int(came[at])
    return out[::-1]


def blocks(rows: DataFrame, extra: list[str], path: str, block_rows: int) -> DataFrame:
    """conv, block, row (its number in the conversation), turn, raw and extra, each block together and in order. Numbered rows are stored at path.

    Rows are sorted by ranges and numbered in each task; only conversations that go on in a further task, one for
    each task at most, get what the tasks before them counted.
    """
    bound_batches(rows.sparkSession)
    # a name that no row without conversation can have
    conv = F.coalesce(F.concat(F.lit(NAMED), F.col("conv_id").cast("string")), F.monotonically_increasing_id().cast("string"))
    held = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").cast("binary").alias("raw"), *extra)
    order = [F.asc("conv"), F.asc_nulls_first("turn"), F.xxhash64("raw")]
    dealt = held.repartitionByRange(*order).sortWithinPartitions(*order, "raw")

    def number(batches):
        last, at = None, 0
        for batch in batches:
            numbers = []
            for conv in batch.column(0).to_pylist():
                last, at = conv, at + 1 if conv == last else 0
                numbers.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "row"])

    numbered = dealt.mapInArrow(number, StructType([*dealt.schema.fields, StructField("row", LongType())])).withColumn("task", F.spark_partition_id())
    numbered = stored(numbered, f"{path}/numbered")
    parts = numbered.groupBy("conv", "task").agg(F.count("*").alias("n"))
    long_ = parts.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = stored(parts.join(long_, "conv").select("conv", "task", F.coalesce(before, F.lit(0)).alias("earlier")), f"{path}/earlier")
    # at most two rows for each task
    placed = numbered.join(F.broadcast(before), ["conv", "task"], "left").withColumn("row", F.col("row") + F.coalesce("earlier", F.lit(0)))
    cut = placed.withColumn("block", F.floor(F.col("row") / block_rows).cast("long")).select("conv", "block", "row", "turn", "raw", *extra)
    return cut.repartition("conv", "block").sortWithinPartitions("conv", "block", "row")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(conv, block) and its rows, from batches in order."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield key, held


def train(labelled: DataFrame) -> Model:
    """Counts states, moves and features of labelled(conv_id, turn, text, role); the counts' number is fixed.

    Each block also gives its first and last state, and moves between blocks are counted from the last state
    before each block, or START where there is none.
    """
    bound_batches(labelled.sparkSession)
    path = work_dir(labelled.sparkSession, "training")

    def run(batches):
        counts: dict[tuple[str, int, int], int] = {}
        ends: list[tuple[str, int, int | None, int | None]] = []

        def add(*key) -> None:
            counts[key] = counts.get(key, 0) + 1

        for (conv, block), rows in grouped(batches):
            state, first, known = None, None, True  # known: no role was unknown since the block's begin
            for _, _, raw, role in rows:
                if role not in ROLES:
                    state, known = None, False
                    continue
                for k, (line, blank) in enumerate(lines_of(raw)):
                    now = 2 * ROLES.index(role) + (k > 0)
                    if state is not None:
                        add("move", state, now)
                    elif known:
                        first = now
                    for f, v in enumerate(features(line, blank)[0]):
                        add(str(f), now, v)
                    state = now
            # a block without lines passes the state before it on, one that ends in an unknown role gives UNKNOWN
            ends.append((conv, block, first, state if state is not None or known else UNKNOWN))
            if len(ends) == 1000:
                yield rows_of([(c, b, "end", i, j, 1) for c, b, i, j in ends])
                ends.clear()
        found = [(c, b, "end", i, j, 1) for c, b, i, j in ends] + [(None, None, *k, n) for k, n in counts.items()]
        if found:
            yield rows_of(found)

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3], strict=True)], names=["conv", "block", "t", "i", "j", "n"])

    found = stored(blocks(labelled, ["role"], path, BLOCK_ROWS).mapInArrow(run, "conv string, block long, t string, i long, j long, n long"), f"{path}/counts")
    ends = found.filter("t = 'end'")
    before = last_before(ends.select("conv", "block", F.when(F.col("j").isNotNull(), F.struct("block", F.col("j").alias("state"))).alias("last")), BLOCK_ROWS)
    between = ends.filter("i is not null").join(before, ["conv", "block"]).select(F.lit("move").alias("t"), F.coalesce("last.state", F.lit(START)).cast("long").alias("i"), F.col("i").alias("j"), "n")
    every = found.filter("t != 'end'").select("t", "i", "j", "n").unionByName(between.filter(F.col("i") != UNKNOWN))
    return Model({(r["t"], r["i"], r["j"]): r["n"] for r in every.groupBy("t", "i", "j").agg(F.sum("n").alias("n")).collect()})


PASSAGE = "conv string, block long, passage array<double>"
BORDER = "conv string, block long, before int, after int"


def matrix(values) -> np.ndarray:
    return np.asarray(values, float).reshape(STATES + 1, STATES + 1)


def all_borders(passages: DataFrame, path: str, block_rows: int, level: int = 0) -> DataFrame:
    """The states before and after each block of passages(conv, block, passage), in tasks of block_rows blocks at most."""
    up = F.floor(F.col("block") / block_rows).cast("long").alias("above")
    if not (passages.agg(F.max("block")).first()[0] or 0) >= block_rows:

        def whole(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("block")
            found = borders([matrix(x) for x in p["passage"]], START, -1)
            return pd.DataFrame({"conv": p["conv"], "block": p["block"], "before": [x[0] for x in found], "after": [x[1] for x in found]})

        return passages.groupBy("conv").applyInPandas(whole, BORDER)

    def lift(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        total = matrix(p["passage"].iloc[0])
        for x in p["passage"].iloc[1:]:
            total = joined(total, matrix(x))
        return pd.DataFrame({"conv": p["conv"].iloc[:1], "block": p["block"].iloc[:1] // block_rows, "passage": [total.ravel().tolist()]})

    above = stored(passages.groupBy("conv", up).applyInPandas(lift, PASSAGE), f"{path}/passages-{level + 1}")
    ends = all_borders(above, path, block_rows, level + 1).select("conv", F.col("block").alias("above"), "before", "after")

    def within(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        found = borders([matrix(x) for x in p["passage"]], int(p["before"].iloc[0]), int(p["after"].iloc[0]))
        return pd.DataFrame({"conv": p["conv"], "block": p["block"], "before": [x[0] for x in found], "after": [x[1] for x in found]})

    return passages.select("*", up).join(ends, ["conv", "above"]).groupBy("conv", "above").applyInPandas(within, BORDER)


TURNS = "conv string, block long, row long, turn long, line long, role string, n_lines long, text string"


def parse(transcripts: DataFrame, model: Model, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per recovered turn of transcripts(conv_id, turn, text): conv (null without one), turn and line where it begins, role, n_lines, text and rendered.

    A turn that goes on over a block's border is put together again by the place where it begins, which is one text cell
    in the end, as a row's text is.
    """
    spark = transcripts.sparkSession
    bound_batches(spark)
    path = work_dir(spark, "transcripts")
    shared = spark.sparkContext.broadcast(model)
    cut = stored(blocks(transcripts, [], path, block_rows), f"{path}/blocks")
    long_ = cut.groupBy("conv").agg(F.max("block").alias("top"), F.min("block").alias("low")).filter("top > low").select("conv")

    def run_passages(batches):
        for (conv, block), rows in grouped(batches):
            seen = [features(*x)[0] for _, _, raw in rows for x in lines_of(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([block], pa.int64()), pa.array([shared.value.passage(seen).ravel().tolist()])], names=["conv", "block", "passage"])

    many = stored(long_, f"{path}/long")
    ends = None
    if many.limit(1).count():  # most conversations are one block
        kept = cut.join(many, "conv", "left_semi").repartition("conv", "block").sortWithinPartitions("conv", "block", "row")
        passages = stored(kept.mapInArrow(run_passages, PASSAGE), f"{path}/passages-0")
        ends = stored(all_borders(passages, path, block_rows), f"{path}/borders")
        cut = cut.join(ends, ["conv", "block"], "left")
    else:
        cut = cut.withColumns({"before": F.lit(None).cast("int"), "after": F.lit(None).cast("int")})
    cut = cut.repartition("conv", "block").sortWithinPartitions("conv", "block", "row")

    def run(batches):
        for (conv, block), rows in grouped(batches):
            before, after = rows[0][3:]
            places, seen, bodies = [], [], []
            for row, turn, raw, _, _ in rows:
                for k, (line, blank) in enumerate(lines_of(raw)):
                    found, size = features(line, blank)
                    places.append((row, turn, k))
                    seen.append(found)
                    bodies.append((line, line[size:]))
            out: list[list] = []
            states = shared.value.states(seen, START if before is None else before, -1 if after is None else after)
            for place, state, (line, body) in zip(places, states, bodies, strict=True):
                if state % 2 == 0:
                    out.append([*place, ROLES[state // 2], 1, [body]])
                elif out:
                    out[-1][4] += 1
                    out[-1][5].append(line)
                else:  # of a turn that began in an earlier block
                    out.append([None, None, None, ROLES[state // 2], 1, [line]])
            if out:
                for x in out:
                    x[5] = "\n".join(x[5])
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(out)), pa.array([block] * len(out), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=[x.split()[0] for x in TURNS.split(", ")])

    turns = cut.select("conv", "block", "row", "turn", "raw", "before", "after").mapInArrow(run, TURNS)
    if ends is not None:
        turns = mended(stored(turns, f"{path}/turns"), block_rows)
    rendered = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>"))
    name = F.when(F.col("conv").startswith(NAMED), F.substring(F.col("conv"), F.lit(len(NAMED) + 1), F.length("conv")))
    return turns.select(name.alias("conv"), "turn", "line", "role", "n_lines", "text", rendered.alias("rendered"))


def last_before(starts: DataFrame, block_rows: int) -> DataFrame:
    """conv, block and last, the greatest of starts(conv, block, last) in the conversation's earlier blocks; level by level, as the borders are."""
    up = F.floor(F.col("block") / block_rows).cast("long")
    earlier = Window.partitionBy("conv", "above").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = starts.withColumn("above", up).withColumn("here", F.max("last").over(earlier))
    if not (starts.agg(F.max("block")).first()[0] or 0) >= block_rows:
        return own.select("conv", "block", F.col("here").alias("last"))
    above = starts.groupBy("conv", up.alias("block")).agg(F.max("last").alias("last"))
    outer = last_before(above, block_rows).select("conv", F.col("block").alias("above"), F.col("last").alias("outer"))
    return own.join(outer, ["conv", "above"]).select("conv", "block", F.coalesce("here", "outer").alias("last"))


def mended(turns: DataFrame, block_rows: int) -> DataFrame:
    """Pieces that begin in an earlier block are added to the turn they belong to. turns is a stored table."""
    starts = turns.groupBy("conv", "block").agg(F.max(F.when(F.col("row").isNotNull(), F.struct("row", "line", "turn"))).alias("last"))
    pieces = turns.filter("row is null")
    found = last_before(starts, block_rows)
    moved = pieces.join(found, ["conv", "block"]).select("conv", "block", F.col("last.row").alias("row"), F.col("last.turn").alias("turn"), F.col("last.line").alias("line"), "role", "n_lines", "text")
    split = moved.select("conv", "row", "line").distinct()
    whole = turns.filter("row is not null")
    parts = whole.join(split, ["conv", "row", "line"], "left_semi").unionByName(moved)
    glued = parts.groupBy("conv", "row", "line").agg(
        F.first("turn").alias("turn"), F.first("role").alias("role"), F.sum("n_lines").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    names = ["conv", "turn", "line", "role", "n_lines", "text"]
    return whole.join(split, ["conv", "row", "line"], "left_anti").select(*names).unionByName(glued.select(*names))


def marker(role: Column, style: Column) -> Column:
    """The marker that a transcript of some style sets before a role's turn; other styles set none."""
    names = [("System", "User", "Assistant"), ("Context", "Human", "AI"), ("Instructions", "Q", "A")]
    out = F.lit("")
    for k, words in enumerate(names):
        for name, word in zip(ROLES, words, strict=True):
            out = F.when((style == k) & (role == name), f"{word}: ").otherwise(out)
    return out


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as transcripts in one of four styles, by conversation: three with markers, of which one in five is missing, and one with blank lines between turns. role stays for training only."""
    style = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 4
    missing = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")) % 5 == 0
    text = F.when(F.col("text").isNull(), None).otherwise(F.concat(F.when(style == 3, "\n").when(missing, "").otherwise(marker(F.col("role"), style)), F.col("text")))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


def recovered_turns(conversations: DataFrame) -> DataFrame:
    """Learn from conversations of which crc32(conv_id as text) mod FOLDS isn't 0, and parse the transcripts of all, without their roles."""
    rows = as_transcripts(conversations)
    learned = rows.filter(F.crc32(F.col("conv_id").cast("string").cast("binary")) % FOLDS != 0)
    return parse(rows.select("conv_id", "turn", "text"), train(learned))
