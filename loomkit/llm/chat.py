"""Chat formatting in prefix trees.

Conversations that share initial turns share a tree. Its distinct paths are sorted by the digests of their turns, so
each path follows the one it shares most with; a path emits only the turns that its predecessor lacks. That is the
tree in depth-first order with each shared token once. A path's position ids go on from its prefix, and its attention
reaches its own tokens so far and the intervals of its ancestors.

Small trees are kept whole. Large ones are cut where the sorted paths of the whole table fall into ranges of about equal
size, whatever turns they share, and ranges into packs of bounded length; a new pack starts with the whole path again,
so every pack can be attended to by itself.

A turn is written `### role: text</turn>` and a line feed. In texts and roles a backslash is doubled, and one is put
inside `</turn>`, after each # that another follows and, in roles, before a colon, so neither mark can be forged and
dropping each first backslash gives the text back.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import broadcast_if_small, cut

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
TURN = re.compile(r"### ((?:[^:\\]|\\.)*): (.*?)</turn>\n", re.S)
LEARNED = "assistant"

# Fixed value: how the public byte-level vocabularies cut a text before their merges.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHARD_PATHS = 256  # paths of a tree that is never cut
RANGE_BYTES = 16 * 64  # of a path that ranges go by: its first 64 turns
PACK_TOKENS = 1 << 16

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
PACKS = pa.schema([
    ("pack_id", pa.string()), ("path_id", pa.string()), ("text", pa.string()), ("token_ids", pa.list_(pa.int32())),
    ("start", pa.int64()), ("position", pa.int64()), ("attends", SPANS), ("char_start", pa.int64()), ("char_attends", SPANS), ("loss", SPANS),
])
PACKS_SQL = """pack_id string, path_id string, text string, token_ids array<int>, start long, position long, attends array<struct<start:long,stop:long>>,
    char_start long, char_attends array<struct<start:long,stop:long>>, loss array<struct<start:long,stop:long>>"""


def escaped(text: str) -> str:
    return re.sub("#(?=#)", r"#\\", text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and where its text stands in it."""
    head = HEAD + escaped(role).replace(":", "\\:") + MIDDLE
    body = escaped(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def encoder(tokenizer_path: str | None):
    """Token ids of a turn: by a file of merge ranks (.tiktoken) or of the tokenizers library, else one for each code point."""
    if tokenizer_path is None:
        return lambda text: [ord(c) for c in text]
    if tokenizer_path.endswith(".tiktoken"):
        import tiktoken

        with open(tokenizer_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def joined(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, stop in spans:
        if out and out[-1]["stop"] == start:
            out[-1]["stop"] = stop
        else:
            out.append({"start": start, "stop": stop})
    return out


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path_id, path, turns) of each conversation; path is the digests of its turns."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    @F.pandas_udf("binary")
    def path(turns):
        return turns.map(lambda ts: b"".join(digest(t["role"], t["text"]) for t in ts))

    return whole.withColumn("path", path("turns")).withColumn("path_id", F.md5("path"))


def packed(ranged: DataFrame, tokenizer_path: str | None, pack_tokens: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        group, first, tokens, chars = None, "", 0, 0
        before: list[bytes] = []
        at: list[tuple[int, int, int, int]] = []
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in PACKS.names}
            for r in batch.to_pylist():
                own = [r["path"][i : i + 16] for i in range(0, len(r["path"]), 16)]
                if r["tree"] != group or tokens >= pack_tokens:
                    group, first, tokens, chars, before, at = r["tree"], r["path_id"], 0, 0, [], []
                shared = 0
                while shared < min(len(own), len(before)) and own[shared] == before[shared]:
                    shared += 1
                at = at[:shared]
                text, ids, loss, position = [], [], [], sum(b - a for a, b, _, _ in at)
                start, char_start = tokens, chars
                for t in r["turns"][shared:]:
                    written, a, b = piece(t["role"], t["text"])
                    if t["role"] == LEARNED:
                        loss.append({"start": chars + a, "stop": chars + b})
                    new = encode(written)
                    at.append((tokens, tokens + len(new), chars, chars + len(written)))
                    tokens, chars = tokens + len(new), chars + len(written)
                    text.append(written)
                    ids += new
                before = own
                values = (f"{group.hex()}-{first}", r["path_id"], "".join(text), ids, start, position, joined([x[:2] for x in at[:shared]]), char_start, joined([x[2:] for x in at[:shared]]), loss)
                for name, value in zip(PACKS.names, values, strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=PACKS)

    by_path = ranged.repartitionByRange("range").sortWithinPartitions("path")
    return by_path.select("tree", "path", "path_id", "turns").mapInArrow(pack, PACKS_SQL)


def format_conversations(conversations: DataFrame, tokenizer_path: str | None = None, pack_tokens: int = PACK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Formats conversations (rows conv_id, turn, role, text) and returns (packs, members).

    packs has a row for each distinct conversation text: pack_id, path_id, the text and token_ids that it adds to its
    pack, start (its first token in the pack), position (the position id of that token), attends (its ancestors'
    intervals in the pack's tokens), char_start and char_attends (the same in code points of the pack's text) and
    loss (intervals of assistant texts that it adds, in code points of the pack). members maps conv_id to path_id.

    Tokens are those of the tokenizer file, encoded turn by turn, or code points. Other columns are left out. Null
    texts and roles are empty; turns are ordered by turn (null first), then role and text, so ties are settled and
    repeated rows are turns of their own. A null conv_id is one conversation. Equal conversations share a path. An
    empty table gives empty tables. Very long texts are written whole; a conversation has to fit in a task's memory, a
    tree need not. The tokenizer file has to be at the same path on every executor; a task that misses it fails.
    """
    whole = cut(paths(conversations))
    members = whole.select("conv_id", "path_id")
    distinct = whole.groupBy("path_id").agg(F.min(F.struct("path", "turns")).alias("p")).select("path_id", "p.path", "p.turns")
    distinct = distinct.withColumn("tree", F.substring("path", 1, 16))
    sizes = whole.select("path_id", F.substring("path", 1, 16).alias("tree")).distinct().groupBy("tree").agg(F.count("*").alias("n"))
    large = cut(sizes.filter(F.col("n") > SHARD_PATHS).select("tree", F.lit(True).alias("large")))
    by = F.when(F.col("large"), F.substring("path", 1, RANGE_BYTES)).otherwise(F.col("tree"))
    ranged = distinct.join(broadcast_if_small(large), "tree", "left").withColumn("range", by)
    return packed(ranged, tokenizer_path, pack_tokens), members


READ = pa.schema([("path_id", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string()), ("formatted_chars", pa.int64())])


def read_pack(rows: list[dict]) -> list[tuple]:
    """The paths of one pack, whose rows come in the order of their text."""
    whole = "".join(r["text"] for r in rows)
    loss = [(s["start"], s["stop"]) for r in rows for s in r["loss"]]
    out = []
    for r in rows:
        spans = [(s["start"], s["stop"]) for s in r["char_attends"]] + [(r["char_start"], r["char_start"] + len(r["text"]))]
        text = "".join(whole[a:b] for a, b in spans)
        learned = [whole[x:y] for a, b in spans for x, y in loss[bisect.bisect_left(loss, (a, 0)) : bisect.bisect_left(loss, (b, 0))]]
        turns = [{"role": unescaped(m[1]), "text": unescaped(m[2])} for m in TURN.finditer(text)]
        out.append((r["path_id"], turns, "".join(map(unescaped, learned)), len(text)))
    return out


def read_back(packs: DataFrame) -> DataFrame:
    """Reads the formatted text again: path_id, turns (role, text), loss_text (what stands under the loss mask,
    unescaped) and formatted_chars of each path. A task holds one pack at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

        held: list[dict] = []
        for batch in batches:
            done: list[tuple] = []
            for row in batch.to_pylist():
                if held and held[0]["pack_id"] != row["pack_id"]:
                    done += read_pack(held)
                    held = []
                held.append(row)
            if done:
                yield table(done)
        if held:
            yield table(read_pack(held))

    needed = packs.select("pack_id", "path_id", "text", "char_start", "char_attends", "loss")
    ordered = needed.repartition("pack_id").sortWithinPartitions("pack_id", "char_start")
    return ordered.mapInArrow(read, "path_id string, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")
