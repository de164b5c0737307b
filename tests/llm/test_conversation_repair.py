import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import keydrift.llm.conversation_repair as repair
from keydrift.llm.conversation_repair import Conversation, Turn, align, repaired, summaries
from keydrift.llm.queries import op12_grammar_alignment

TURNS = "conv_id long, turn long, role string, text string"


def least(turns):
    """Cost, audit and result of the cheapest repair, by all edits at every turn: no lengths, bands or blocks."""
    def closed(ways):
        for _ in range(4):
            for state, (cost, audit, out) in list(ways.items()):
                symbol = "a" if state == "u" else "u"
                put(ways, symbol, (cost + 2, audit + "I", (*out, ({"u": "user", "a": "assistant"}[symbol], ""))))
        return ways

    def put(ways, state, way):
        if state not in ways or way[:2] < ways[state][:2]:
            ways[state] = way

    ways = closed({"": (0, "", ())})
    for role, text, wrong in turns:
        after = {}
        for state, (cost, audit, out) in ways.items():
            put(after, state, (cost + 3, audit + "D", out))
            if wrong in ("blank", "duplicate"):
                continue
            stays = wrong == "truncated"
            for symbol in ("a",) if state == "u" else ("u",) if state else ("s", "u"):
                if role[:1] == symbol:
                    put(after, symbol, (cost + stays, audit + "K", (*out, (role, text))))
                elif symbol != "s":
                    put(after, symbol, (cost + 2 + stays, audit + "R", (*out, ({"u": "user", "a": "assistant"}[symbol], text))))
        ways = closed(after)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def expected(rows, faulty=True):
    """The contract's row for every conversation, from plain Python."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == conv_id):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20 if faulty else 9
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            turns += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, judged = set(), []
        for _, role, text in turns:
            said = text.strip(" \t\n\x0b\x0c\r")
            wrong = "blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, wrong))
        numbers = [t[0] for t in turns if t[0] is not None]
        cost, audit, result = least(judged)
        faults = [w for _, _, w in judged]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
        out[conv_id] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest(),
        )
    return out


def told(frame):
    return {r.conv_id: tuple(r)[1:9] for r in frame.collect()}


def random_turns(seed, conversations, most):
    draw = random.Random(seed)
    rows = []
    for c in range(conversations):
        for k in range(draw.randrange(most)):
            text = draw.choice(["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Well. ", "a\nb."])
            rows.append((c, draw.choice([k, k, k, k + 3, None]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), text))
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_blocks_of_any_size_find_the_least_audit(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    draw = random.Random(block)
    for _ in range(400):
        turns = [(draw.choice(["user", "assistant", "system", "tool", "", " "]), "x", draw.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(draw.randrange(14))]
        now, rows = Conversation(1), []
        for i, (role, text, wrong) in enumerate(turns):
            rows += now.add(Turn(i, role, text, wrong))
        rows += now.end()
        edits = [e for r in rows for e in r["edits"]]
        cost, audit, result = least(turns)
        assert (sum(r["cost"] for r in rows), "".join(e["edit"] for e in edits)) == (cost, audit)
        assert tuple((e["role"], e["text"]) for e in edits if e["edit"] != "D") == result
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in result))


def test_band_is_exact_at_its_bound():
    turns = [Turn(i, role, "x.", None) for i, role in enumerate(["user", "user", "assistant", "system", "assistant"])]
    for target in ("", "ua", "uaua", "uauaua", "sua"):
        full = align(turns, target, 1000)
        for bound in range(full[0] + 1 if full else 30):
            assert align(turns, target, bound) == (full if full and full[0] <= bound else None)


def test_settled_blocks_leave_before_the_end():
    now, rows = Conversation(1), []
    for i in range(2000):
        rows += now.add(Turn(i, ("user", "assistant")[i % 2], f"{i}.", None))
        assert len(now.waiting) <= 2
    assert len(rows) >= 2000 // repair.BLOCK - 3


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(op12_grammar_alignment(spark, folder)) == expected(rows)


def test_query_on_odd_rows(spark, tmp_path):
    rows = random_turns(3, 60, 25) + [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Ho.")]
    rows += [(-5, 7, "user", "Hi.")] * 4
    frame = spark.createDataFrame(rows, TURNS).withColumn("edits", F.lit(1)).withColumn("lost", F.lit(True)).withColumn("fault", F.lit(2))
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert told(op12_grammar_alignment(spark, str(tmp_path))) == expected(rows)


def test_long_conversation_and_lost_rows(spark):
    draw = random.Random(1)
    rows = [(1, i, "user" if i % 2 == 0 or draw.random() < 0.1 else "assistant", f"turn {i}" + draw.choice([".", "."," "])) for i in range(1500) if draw.random() < 0.95]
    rows.append((1, 2000, "user", "long " * 100_000))
    frame = spark.createDataFrame(rows, TURNS)
    assert told(summaries(repaired(frame))) == expected(rows, faulty=False)
    blocks = repaired(frame).collect()
    assert [b.block for b in blocks] == list(range(len(blocks))) and max(len(b.edits) for b in blocks) <= 2 * repair.BLOCK + 2
    empty = summaries(repaired(frame, F.lit(True))).collect()
    assert [(r.conv_id, r.gaps, r.cost, r.audit, r.repaired_sha256) for r in empty] == [(1, 0, 0, "", hashlib.sha256().hexdigest())]


def test_no_rows(spark):
    assert summaries(repaired(spark.createDataFrame([], TURNS))).count() == 0
