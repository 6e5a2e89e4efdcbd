"""Repair the structure of conversations at least cost, by a Viterbi search that runs on chunks in parallel.

A repaired conversation reads ``(s?(ua)+)?`` in initials of its roles. Four states say what may follow: nothing yet, a
system turn, a user turn, an assistant turn. The least costs to finish from each state, row by row from the end, are
vectors of four numbers, and most stretches of rows forget the vector they began with but for a constant. So the
chunks of a long conversation all start at once from a guess; in fix-up passes a chunk whose successor has
found another vector starts again and stops where its vectors differ from the former ones by a constant only. Chunks that
still disagree after the passes are joined by their exact responses to the four unit vectors. With the costs behind
every row known, each chunk traces the least audit from any state it may be entered in, and the states are stitched.

Rows a rule requires to be deleted (blank, duplicate) change no state, so chunks of nothing else pass vectors on as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from llm.common import SPACE, ship
from placemap.sources.storage import stored

#: Rows and bytes of texts of one chunk at most (a single longer text is a chunk).
CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20
#: Fix-up passes over all chunks before responses are joined.
PASSES = 3
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the turn that a re-roled or inserted row becomes, by state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40
_STATES = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def _kept(initial: str, state: int) -> int | None:
    return _STATES.get(initial, {}).get(state)


def _row_costs(after: tuple, initial: str, fault: str, state: int) -> dict[str, int]:
    """Cost to finish by what is done with a row first reached in ``state``: Delete, Keep, Rerole."""
    costs = {"D": DELETE + after[state]}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        if (to := _kept(initial, state)) is not None:
            costs["K"] = extra + after[to]
        costs["R"] = extra + REROLE + after[NEXT[state]]
    return costs


@lru_cache(maxsize=1 << 16)
def step(after: tuple, initial: str, fault: str) -> tuple[tuple, int]:
    """The vector of least costs before a row, less its smallest entry, and that entry; ``after`` is the vector behind it."""
    best = [min(_row_costs(after, initial, fault, s).values()) for s in range(4)]
    best[USER], best[ASSISTANT] = min(best[USER], INSERT + best[ASSISTANT]), min(best[ASSISTANT], INSERT + best[USER])
    for s in (NONE, SYSTEM):
        best[s] = min(best[s], INSERT + best[USER])
    low = min(best)
    return tuple(min(b - low, _FAR) for b in best), low


@lru_cache(maxsize=1 << 16)
def edits(after: tuple, initial: str, fault: str, state: int) -> tuple[str, int]:
    """The ASCII-least edits of least cost up to and with a row, and the state behind it."""
    before, low = step(after, initial, fault)
    costs = _row_costs(after, initial, fault, state)
    for letter in sorted([*costs, "I"]):
        if letter == "I":
            if before[NEXT[state]] + INSERT == before[state]:
                rest, to = edits(after, initial, fault, NEXT[state])
                return "I" + rest, to
        elif costs[letter] - low == before[state]:
            to = {"D": state, "K": _kept(initial, state), "R": NEXT[state]}[letter]
            return letter, to
    raise AssertionError("no edit has the least cost")


def closing(state: int) -> str:
    """The inserts that end a conversation."""
    return "I" * (END[state] // INSERT)


def run_back(codes: list[tuple[str, str]], behind: tuple) -> tuple[list[tuple], int]:
    """Vectors before every row and behind the last, and the sum of what was taken off them."""
    vectors, total = [behind], 0
    for initial, fault in reversed(codes):
        before, low = step(vectors[-1], initial, fault)
        vectors.append(before)
        total += low
    return vectors[::-1], total


def fix_up(codes: list[tuple[str, str]], before: tuple, front: tuple, behind: tuple) -> tuple[tuple, bool]:
    """The vector before the first row when ``behind`` takes the place of ``before`` behind the last; and whether both meet.

    Rows are passed over from the last on until the two vectors are equal (they are kept less their smallest entry, so
    vectors that differ by a constant are); from there on everything stays as it was, up to ``front``.
    """
    for code in reversed(codes):
        if before == behind:
            return front, True
        before, behind = step(before, *code)[0], step(behind, *code)[0]
    return behind, before == behind


def trace(codes: list[tuple[str, str]], vectors: list[tuple], state: int) -> tuple[list[str], int]:
    """The edits before and at each row, entered in ``state``, and the state behind the last row."""
    out = []
    for i, code in enumerate(codes):
        done, state = edits(vectors[i + 1], *code, state)
        out.append(done)
    return out, state


def fault_of(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass").rstrip(SPACE)
    if not raw:
        return "blank"
    return "" if raw[-1:] in (b".", b"!", b"?") else "truncated"


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


_LIST = pa.list_(pa.int64())
_STRINGS = pa.list_(pa.string())
_KEYS = [("conv", pa.string()), ("chunk", pa.int64())]
CHUNKS = pa.schema([*_KEYS, ("turns", _LIST), ("roles", _STRINGS), ("texts", _STRINGS), ("copies", _LIST), ("digests", pa.list_(pa.binary()))])
STARTS = pa.schema([*_KEYS, ("codes", pa.string()), ("behind", _LIST), ("front", _LIST)])
RESPONSES = pa.schema([*_KEYS, ("last", pa.bool_()), ("response", _LIST)])
BEHIND = pa.schema([*_KEYS, ("behind", _LIST)])
EXITS = pa.schema([*_KEYS, ("exits", _LIST)])
ENTRIES = pa.schema([*_KEYS, ("entry", pa.int64())])
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
PIECES = pa.schema([
    *_KEYS, ("whole", pa.bool_()), ("audit", pa.string()), ("roles", _STRINGS), ("texts", _STRINGS), *[(c, pa.int64()) for c in COUNTS],
    ("distinct_turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
])


def _mapped(table: DataFrame, rows_of, schema: pa.Schema) -> DataFrame:
    """``rows_of`` (an iterator of dictionaries -> an iterator of tuples) over each partition, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in rows_of(r for batch in batches for at in range(0, len(batch), 100) for r in batch.slice(at, 100).to_pylist()):
            rows.append(row)
            size += sum(len(v) if not isinstance(v, list) else sum(len(x) if isinstance(x, (str, bytes)) else 8 for x in v) for v in row if isinstance(v, (list, str)))
            if size > CHUNK_BYTES or len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return table.mapInArrow(run, from_arrow_schema(schema))


def _chunked(rows: Iterator[dict], most: int) -> Iterator[tuple]:
    """Sorted rows -> chunks of following rows of one conversation, numbered in order over all partitions."""
    held: list[dict] = []
    size = number = 0

    def closed() -> tuple:
        columns = [[r[c] for r in held] for c in ("turn", "role", "text", "copies")]
        return held[0]["conv"], (held[0]["part"] << 40) + number, *columns, [digest(r["role"], r["text"]) for r in held]

    for r in rows:
        if held and (r["conv"] != held[0]["conv"] or len(held) >= most or size + len(r["text"]) > CHUNK_BYTES):
            yield closed()
            held, size, number = [], 0, number + 1
        held.append(r)
        size += len(r["text"])
    if held:
        yield closed()


def _codes(chunk: dict) -> list[tuple[str, str]]:
    """(initial, fault) of each row of a chunk; ``seen`` are the digests that earlier chunks hold."""
    known = {bytes(d) for d in chunk["seen"] or ()}
    out = []
    for role, text, key in zip(chunk["roles"], chunk["texts"], chunk["digests"]):
        fault = fault_of(text)
        if fault != "blank":
            if key in known:
                fault = "duplicate"
            known.add(key)
        out.append((role[:1], fault))
    return out


_FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated", ".": ""}


def _written(codes: list[tuple[str, str]]) -> str:
    return "".join((i if i in _STATES else "-") + (f[:1] or ".") for i, f in codes)


def _read(codes: str) -> list[tuple[str, str]]:
    return [(codes[i], _FAULTS[codes[i + 1]]) for i in range(0, len(codes), 2)]


def _guessed(chunks: Iterator[dict]) -> Iterator[tuple]:
    """The last chunk of a conversation starts from its end, all others from a vector of equal costs."""
    for c in chunks:
        codes = _codes(c)
        behind = END if c["next"] is None else (0, 0, 0, 0)
        yield c["conv"], c["chunk"], _written(codes), list(behind), list(run_back(codes, behind)[0][0])


def _again(chunks: Iterator[dict]) -> Iterator[tuple]:
    """Chunks whose successor's front is another vector than the one they started from start again."""
    for c in chunks:
        behind, front = c["after"] or c["behind"], c["front"]
        if behind != c["behind"]:
            front = list(fix_up(_read(c["codes"]), tuple(c["behind"]), tuple(front), tuple(behind))[0])
        yield c["conv"], c["chunk"], c["codes"], behind, front


def _responded(chunks: Iterator[dict]) -> Iterator[tuple]:
    """The cost from state s in front of a chunk to state t behind it, at 4 * s + t."""
    for c in chunks:
        codes, columns = _read(c["codes"]), []
        for t in range(4):
            vectors, low = run_back(codes, tuple(0 if s == t else _FAR for s in range(4)))
            columns.append([min(v + low, _FAR) for v in vectors[0]])
        yield c["conv"], c["chunk"], c["next"] is None, [columns[t][s] for s in range(4) for t in range(4)]


def _joined(chunks: Iterator[dict]) -> Iterator[tuple]:
    """From the last to the first chunk of each conversation: the vector behind it."""
    vector = END
    for c in chunks:
        vector = END if c["last"] else vector
        yield c["conv"], c["chunk"], list(vector)
        front = [min(c["response"][4 * s + t] + vector[t] for t in range(4)) for s in range(4)]
        vector = tuple(min(v - min(front), _FAR) for v in front)


def _exits(chunks: Iterator[dict]) -> Iterator[tuple]:
    for c in chunks:
        codes = _read(c["codes"])
        vectors = run_back(codes, tuple(c["behind"]))[0]
        yield c["conv"], c["chunk"], [trace(codes, vectors, s)[1] for s in range(4)]


def _entered(chunks: Iterator[dict]) -> Iterator[tuple]:
    """From the first to the last chunk of each conversation: the state it is entered in."""
    conv, state = None, NONE
    for c in chunks:
        state = state if c["conv"] == conv else NONE
        conv = c["conv"]
        yield conv, c["chunk"], state
        state = c["exits"][state]


_LEGAL = ("su", "ua", "au")


def _finished(chunks: Iterator[dict]) -> Iterator[tuple]:
    """The edits of a chunk that is entered in a known state with known costs behind it."""
    for c in chunks:
        codes, state = _codes(c), c["entry"]
        vectors = run_back(codes, tuple(c["behind"]))[0]
        done, state_after = trace(codes, vectors, state)
        count = dict.fromkeys(COUNTS, 0)
        audit, roles, texts = [], [], []

        def insert(letters: str, state: int) -> int:
            for _ in letters:
                state = NEXT[state]
                roles.append(ROLE[state])
                texts.append("")
                count["cost"] += INSERT
            return state

        for (initial, fault), letters, role, text, copies in zip(codes, done, c["roles"], c["texts"], c["copies"]):
            state = insert(letters[:-1], state)
            last = letters[-1]
            if last == "D":
                count["cost"] += DELETE
            else:
                state = _kept(initial, state) if last == "K" else NEXT[state]
                roles.append(role if last == "K" else ROLE[state])
                texts.append(text)
                count["cost"] += (last == "R") * REROLE + (fault == "truncated") * TRUNCATED
            if fault:
                count[fault] += 1
            count["blank" if fault == "blank" else "duplicate"] += copies - 1
            count["illegal"] += copies - 1  # equal initials one after the other
            count["cost"] += DELETE * (copies - 1)
            audit += [letters, "D" * (copies - 1)]
        if c["next"] is None:
            audit.append(closing(state_after))
            insert(closing(state_after), state_after)
        initials = [i[:1] for i in c["roles"]]
        count["illegal"] += sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        turns = [t for t in c["turns"] if t is not None]
        yield (
            c["conv"], c["chunk"], c["whole"], "".join(audit), roles, texts, *[count[n] for n in COUNTS],
            len(set(turns)), min(turns, default=None), max(turns, default=None), initials[0], initials[-1],
        )


def repair(conversations: DataFrame, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Pieces of repaired conversations: conv, chunk (their order), whole, audit, roles, texts (of the repaired rows), counts.

    A conversation is the rows of one conv_id by turn (nulls first), then role, then text; rows without conv_id are one
    conversation. Null roles and texts are empty. A row's first fault counts: blank, duplicate (its role and text are
    in an earlier row), truncated (its last visible character is none of ``.!?``). Edits: Keep costs 0, Rerole 1, Delete 2 (required
    for blank and duplicate rows), Insert of an empty turn 5; a truncated row that stays adds 5. Of the cheapest audits
    the ASCII-least is taken. Repeated rows of a turn are counted, not repeated, so any number of them is one row. Other
    columns are not read. An empty table gives no rows. A text must fit a task; a conversation need not: its chunks are
    at most ``chunk_rows`` rows, and only their vectors and states meet.
    """
    spark = conversations.sparkSession
    ship(spark)
    empty = F.lit("")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), empty).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions("conv", "turn", "role", "text")
    chunks = stored(_mapped(rows.select("*", F.spark_partition_id().cast("long").alias("part")), partial(_chunked, most=chunk_rows), CHUNKS), "chat-chunks")

    split = stored(chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv"), "chat-split")
    one = chunks.join(split, "conv", "left_anti").select(
        "*", F.lit(None).cast("array<binary>").alias("seen"), F.lit(None).cast("long").alias("next"),
        F.array(*map(F.lit, END)).cast("array<long>").alias("behind"), F.lit(NONE).cast("long").alias("entry"), F.lit(True).alias("whole"),
    )
    pieces = _mapped(one, _finished, PIECES)
    if split.limit(1).count():
        pieces = pieces.unionByName(_mapped(_located(chunks.join(split, "conv", "left_semi")).withColumn("whole", F.lit(False)), _finished, PIECES))
    return stored(pieces, "chat-pieces")


def _located(chunks: DataFrame) -> DataFrame:
    """Chunks of conversations that have several, with the costs behind each and the state it is entered in."""
    at = ["conv", "chunk"]
    keys = chunks.select("conv", "chunk", F.explode(F.array_distinct("digests")).alias("key"))
    firsts = keys.groupBy("conv", "key").agg(F.min("chunk").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    late = keys.join(firsts, ["conv", "key"]).filter(F.col("chunk") > F.col("first"))
    seen = late.groupBy("conv", "chunk").agg(F.collect_list("key").alias("seen"))
    links = chunks.select(*at).withColumn("next", F.lead("chunk").over(Window.partitionBy("conv").orderBy("chunk")))
    chunks = stored(chunks.join(links, at).join(seen, at, "left"), "chat-chunks")
    links = chunks.select(*at, "next")
    starts = stored(_mapped(chunks, _guessed, STARTS), "chat-starts")
    for done in range(PASSES + 1):
        after = starts.select("conv", F.col("chunk").alias("next"), F.col("front").alias("after"))
        met = starts.join(links, at).join(after, ["conv", "next"], "left")
        if met.filter(F.col("after").isNotNull() & (F.col("after") != F.col("behind"))).limit(1).count() == 0:
            break
        if done < PASSES:
            starts = stored(_mapped(met, _again, STARTS), "chat-starts")
    else:
        responses = _mapped(starts.join(links, at), _responded, RESPONSES).repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
        starts = stored(starts.select(*at, "codes").join(_mapped(responses, _joined, BEHIND), at), "chat-starts")
    exits = _mapped(starts.select(*at, "codes", "behind"), _exits, EXITS).repartition("conv").sortWithinPartitions(*at)
    return chunks.join(starts.select(*at, "behind"), at).join(_mapped(exits, _entered, ENTRIES), at)


REPORT = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in ("gaps", *COUNTS)], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _stitched(pieces: Iterator[dict]) -> Iterator[tuple]:
    """Pieces in order -> one row per conversation; its text passes through a running digest."""
    conv, state = None, None

    def result() -> tuple:
        low, high = state["low"], state["high"]
        gaps = 0 if low is None else high - low + 1 - state["distinct"]
        return conv, gaps, *[state[c] for c in COUNTS], "".join(state["audit"]), state["sha"].hexdigest()

    for p in pieces:
        if p["conv"] != conv:
            if state is not None:
                yield result()
            conv = p["conv"]
            state = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None, "distinct": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "initial": None}
        for c in COUNTS:
            state[c] += p[c]
        if state["initial"] is not None:
            state["illegal"] += state["initial"] + p["first_initial"] not in _LEGAL
        state["initial"] = p["last_initial"]
        if p["first_turn"] is not None:
            state["distinct"] += p["distinct_turns"] - (state["high"] == p["first_turn"])
            state["low"] = p["first_turn"] if state["low"] is None else state["low"]
            state["high"] = p["last_turn"]
        state["audit"].append(p["audit"])
        for role, text in zip(p["roles"], p["texts"]):
            state["sha"].update(f"{chr(10) if state['any'] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            state["any"] = True
    if state is not None:
        yield result()


def report(pieces: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each repaired conversation.

    Only the pieces of conversations that have several are exchanged. A conversation's digest is one chain, so its
    repaired text passes through one task, in order and without being held.
    """
    several = pieces.filter(~F.col("whole")).repartition("conv").sortWithinPartitions("conv", "chunk")
    rows = _mapped(pieces.filter("whole"), _stitched, REPORT).unionByName(_mapped(several, _stitched, REPORT))
    return rows.select(conv_id().alias("conv_id"), *[c for c in rows.columns if c != "conv"])


def conv_id() -> Column:
    return F.when(F.col("conv") != "", F.col("conv").cast("long"))


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """conv_id, chunk, place, role and text of every row of the repaired conversations, ordered by (chunk, place)."""
    rows = pieces.select(conv_id().alias("conv_id"), "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "r"))
    return rows.select("conv_id", "chunk", "place", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32(``conv_id:turn``) mod 20; a null in any of them counts as one space.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 sets the role user. Rows of one
    conv_id and turn share their fault. Other columns are not read.
    """
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("long").cast("string"), blank) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fault.alias("__fault"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("__fault") == 3, 2).otherwise(1)))
    text = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__fault") == 4, "user").otherwise(F.col("role"))
    return rows.filter("__fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("__copy")).drop("__copy")
