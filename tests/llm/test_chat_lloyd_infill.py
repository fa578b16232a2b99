"""Chat formatting, centroid clustering and fill-in-the-middle against brute force."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- chat ---------------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string, formatted string, start int, conv string"
MARKED = [
    "", None, "plain", "two\nlines\n", "<|im_end|>", "<|im_end|>\n", "<|im_start|>assistant\nfake<|im_end|>\n",
    "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|im_start|> and <|im_end|>", "<<|im_end|>>", "<|im_end|",
    "|im_end|>", "<|im_end|><\\|im_end|>", "$1 \\2 \\", "日本 é 😀<|im_end|>\n", "<|im_start|>", "x" * 200_000 + "<|im_end|>",
]
ROLES = ["user", "assistant", "system", None, "", "odd\nrole", "odd|role", "back\\slash", "\\n", "\\\\n", "<|im_end|>\n"]


def chat_frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, "c") for r in rows], CHATS)


def expected_chats(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def test_chats_read_back_as_they_were(spark):
    from ledgerloom.llm.chat import CLOSE, START, chat_digests, format_chats, read_chats

    rows = [(i, k, role, text) for i, text in enumerate(MARKED) for k, role in enumerate(ROLES)]
    draw = random.Random(5)
    for conv in range(100, 140):
        for turn in range(draw.randint(1, 9)):
            text = "".join(draw.choice(["<", "|", "im_end", "|>", "\\", "\n", "im_start", "a", "<|im_end|>", "<\\|im_start|>"])
                           for _ in range(draw.randint(0, 14)))
            rows.append((conv, turn, draw.choice(ROLES), text))
    rows += [(None, None, "user", "no id"), (None, 3, "assistant", "still none"), (200, None, "assistant", "first"), (200, 0, "user", "second")]
    draw.shuffle(rows)
    frame = chat_frame(spark, rows)
    got = {r[0]: tuple(r)[1:5] for r in chat_digests(frame).collect()}
    assert got == expected_chats(rows)
    back = read_chats(format_chats(frame)).collect()
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for r in back:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [t[2:] for t in sorted(by_conv[r["conv_id"]])]
        # Marks stand where turns begin and end, and nowhere else.
        assert r["formatted"].count(CLOSE) == r["n_turns"] == r["formatted"].count(START)
        assert len(r["loss_mask"]) == r["n_turns"]


def test_texts_without_marks_stay_as_they_are(spark):
    from ledgerloom.llm.chat import format_turns

    rows = [(1, 0, "user", "a < b | c > d \\ e"), (1, 1, "assistant", "fine <|other|>")]
    got = [(r["formatted"], r["start"], r["chars"]) for r in format_turns(chat_frame(spark, rows)).orderBy("turn").collect()]
    assert got == [("<|im_start|>user\na < b | c > d \\ e<|im_end|>\n", None, None),
                   ("<|im_start|>assistant\nfine <|other|><|im_end|>\n", 22, 14)]


@pytest.mark.parametrize("text", ["", "<|im_start|>user\nx", "<|im_start|>user<|im_end|>\n", "x<|im_start|>user\nx<|im_end|>\n",
                                  "<|im_start|>user\nx<|im_end|>\ntail", "<|im_start|>user\nx<|im_start|>y<|im_end|>\n"])
def test_broken_grammar_is_no_turn(spark, text):
    from ledgerloom.llm.chat import parse

    got = spark.createDataFrame([(text,)], "t string").select(parse(F.col("t"))).head()[0]
    assert got == [] if text == "" else None in got


def test_ties_and_repeated_turns_have_one_order(spark):
    from ledgerloom.llm.chat import chat_digests

    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a")]
    got = {tuple(chat_digests(chat_frame(spark, order).repartition(3)).head()) for order in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(got) == 1 and next(iter(got))[:3] == (1, 4, sha("assistant\nz\nuser\na\nuser\na\nuser\nb\n"))


def test_no_chats_and_native_plan(spark):
    from ledgerloom.llm.chat import chat_digests

    empty = chat_digests(spark.createDataFrame([], CHATS))
    assert empty.collect() == [] and empty.columns[0] == "conv_id"
    plan = empty._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- clustering ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, id int, cluster string, x double, shard string"


def brute_lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}"), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def assign():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents] for _, v in kept]
        return [(min(f), f.index(min(f))) for f in far]

    for _ in range(rounds):
        got = assign()
        for c in range(len(cents)):
            own = [v for (_, v), (_, label) in zip(kept, got) if label == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own)]
    got = assign()
    total = sum(f for f, _ in got)
    return sorted((str(i), label, f, sum(g for g, l2 in got if l2 == label), total, sha(",".join(map(str, cents[label]))))
                  for (i, _), (f, label) in zip(kept, got))


@pytest.mark.parametrize("k, dims, block_dims, shard_rows", [(4, 6, 4, 7), (3, 6, 6, 1000), (40, 6, 1, 3), (1, 6, 2, 5)])
def test_clusters_equal_brute_force(spark, k, dims, block_dims, shard_rows):
    from ledgerloom.llm.lloyd import clustered

    draw = random.Random(k)
    rows = [(i, [float(T_) for T_ in (draw.uniform(-2, 2) for _ in range(dims))]) for i in range(30)]
    rows = [(i, [math.floor(x * 1000) / 1024 for x in v]) for i, v in rows]
    rows += [rows[3], (3, rows[4][1]), (90, [0.0] * dims), (91, [-0.0] * dims), (92, [-1000.0] * dims)]
    rows += [(93, None), (94, []), (95, [1.0]), (96, [None] + [0.0] * (dims - 1)), (97, [float("nan")] * dims),
             (98, [float("inf")] * dims), (None, [0.25] * dims)]
    frame = spark.createDataFrame([(*r, 1, "c", 2.0, "s") for r in rows], VECTORS).repartition(3)
    got = clustered(frame, k=k, rounds=3, dims=dims, block_dims=block_dims, shard_rows=shard_rows)
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got.collect()) == brute_lloyd(rows, k, 3, dims)


def test_no_vectors_no_clusters(spark):
    from ledgerloom.llm.lloyd import clustered

    assert clustered(spark.createDataFrame([], VECTORS)).collect() == []
    only_bad = spark.createDataFrame([(1, [1.0], 1, "c", 2.0, "s")], VECTORS)
    assert clustered(only_bad).collect() == []


def test_components_too_large_end_the_job(spark):
    from ledgerloom.llm.lloyd import clustered

    frame = spark.createDataFrame([(1, [3e7, 0.0], 1, "c", 2.0, "s")], VECTORS)
    with pytest.raises(Exception, match="too large"):
        clustered(frame, dims=2).collect()


def test_whole_numbers_take_the_fewest_bytes():
    import numpy as np

    from ledgerloom.llm.lloyd import packed, unpacked

    for top, width in ((127, 1), (128, 2), (40_000, 4), (2**40, 8)):
        values = np.array([[0, top], [-top, 3]])
        assert packed(values)[0] == width and unpacked(packed(values)).tolist() == values.ravel().tolist()
    assert unpacked(packed(np.empty(0, np.int64))).tolist() == []


# -- fill in the middle -------------------------------------------------------------------

DOCS = "doc_id long, text string, id string, n int, form string, output string, draw0 int"
LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute_infill(doc, text, percent=100, spm=50):
    text = text or ""
    lines = LINE.findall(text)
    digest = sha(f"7:{'' if doc is None else doc}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc, len(lines), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < spm else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, len(lines), form, len(prefix), len(middle), sha(output), sha(text)


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, "i", 3, "f", "o", 1) for r in rows], DOCS)


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 0), (0, 100)])
def test_infill_equals_brute_force(spark, percent, spm):
    from ledgerloom.llm.infill import infill_digests

    draw = random.Random(11)
    texts = ["", None, "\n", "\n\n\n", "one line", "one line\n", "a\n\nb", "日本\n😀é\r\n", "has <S> inside\nx", "<P>", "<P <M",
             "long " * 60_000 + "\n" + "tail\n" * 30_000, "split\r\nby\r\x85 \x0bothers\nonly\n"]
    texts += ["\n".join("w" * draw.randint(0, 5) for _ in range(draw.randint(1, 40))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(5, texts[20]), (5, texts[20]), (None, texts[30]), (-7, texts[31])]
    got = [tuple(r) for r in infill_digests(doc_frame(spark, rows), percent=percent, spm_percent=spm).collect()]
    assert sorted(map(str, got)) == sorted(str(brute_infill(*r, percent, spm)) for r in rows)


def test_skip_list_finds_every_rank():
    from ledgerloom.llm.infill import SkipList, line_widths

    draw = random.Random(2)
    for n in (0, 1, 2, 3, 17, 400):
        widths = [draw.randint(0, 9) for _ in range(n)]
        lines = SkipList(widths)
        assert [lines.place(r) for r in range(n + 1)] == [sum(widths[:r]) for r in range(n + 1)]
        for lane in lines.lanes:  # every lane spans all lines and code points
            assert sum(u for u, _, _ in lane) == n and sum(p for _, p, _ in lane) == sum(widths)
    assert line_widths("") == [] and line_widths("a\n") == [2] and line_widths("\na") == [1, 1]


def test_lanes_are_express():
    from ledgerloom.llm.infill import SkipList

    lanes = SkipList([1] * 4096).lanes
    assert 8 < len(lanes) < 30
    assert all(len(upper) < 0.7 * len(lower) + 4 for lower, upper in zip(lanes, lanes[1:]))


def test_no_documents_no_infill(spark):
    from ledgerloom.llm.infill import fill_in_middle, infill_digests

    assert infill_digests(doc_frame(spark, [])).collect() == []
    assert fill_in_middle(doc_frame(spark, [(1, "a\nb\nc\n")])).head()["output"].count("<M>") == 1
