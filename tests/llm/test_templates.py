import random

import pytest

from shelfkin.llm import templates

SCHEMA = "doc_id long, text string, lines string"


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return docs, {(r.doc_id, r["__dropped"].n_dropped): r.text for r in templates.deduplicate(docs, "__dropped").collect()}


def test_variable_fields(spark):
    docs, got = run(spark, [
        (1, "user 17 logged in from 10.0.0.1 today\nonly here is this one line"),
        (2, "user 99 logged in from 10.9.9.9 today\nanother line that is new here"),
        (3, "the report of the week was read by alice in the room"),
        (4, "the report of the week was read by bobby in the room"),
        (5, "the report of the week was seen by bobby in the hall"),
        (6, "a b c d"), (7, "a b c d"), (8, "page 3"), (9, "page 4\n\n 3 "), (10, "page\t3\n3"),
    ])
    assert got[1, 0].startswith("user 17") and got[2, 1] == "another line that is new here"
    assert got[3, 0] and got[4, 1] == "" and got[5, 0]
    # Short lines recur as they stand, blanks aside: no digit is a variable field there.
    assert got[6, 0] == "a b c d" and got[7, 1] == ""
    assert got[8, 0] == "page 3" and got[9, 0] == "page 4\n\n 3 " and got[10, 2] == ""
    assert [r.doc_id for r in templates.keep_first(docs).orderBy("doc_id").collect()] == [1, 2, 3, 5, 6, 8, 9]
    assert templates.keep_first(docs).columns == docs.columns


def test_odd_rows(spark):
    line = "one two three four five six"
    docs, got = run(spark, [
        (1, None), (1, None), (2, ""), (3, "\n\n"), (None, line), (5, f"{line}\n\n{line}\nx"), (5, f"{line}\n\n{line}\nx"),
        (6, f"  {line.replace(' ', chr(9))} \r"), (7, "\n".join(f"w{i} w{i} w w w w {i}" for i in range(20_000))),
        (8, "y" * 200_000 + " a b c d 1\n" + line),
    ])
    assert got[1, 0] is None and got[2, 0] == "" and got[3, 0] == "\n\n"
    assert got[None, 0] == line and got[5, 2] == "\nx" and got[6, 1] == ""
    assert got[7, 0].count("\n") == 19_999 and got[8, 1].endswith(" 1")
    kept = templates.keep_first(docs)
    assert kept.count() == 9 and kept.columns == docs.columns
    assert templates.deduplicate(docs.limit(0)).count() == 0


def test_equals_plain_tree(spark):
    rng = random.Random(5)
    words = [f"v{c}" for c in "abcdefgh"]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 14))] for _ in range(16)]
    rows = {}
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice([*words, "7", "x9"])
            lines.append(line)
        rows[i] = lines

    def of(line):
        if len(line) < templates.LEAST:
            return [(len(line), -1, tuple(line))]
        line = ["<*>" if any(c.isdigit() for c in w) else w for w in line]
        n, out = len(line), [(len(line), -1, tuple(line))]
        if n >= templates.WILD_FROM:
            for k in range(8):
                a, b = 3 + (n - 3) * k // 8, 3 + (n - 3) * (k + 1) // 8
                if b > a:
                    out.append((n, k, tuple(line[:a] + line[b:])))
        return out

    holders = {}
    for i, lines in rows.items():
        for line in lines:
            for t in of(line):
                holders.setdefault(t, set()).add(i)
    want = {}
    for i, lines in rows.items():
        first = [min([min(holders[t]) for t in of(x)], default=i) for x in lines]
        want[i] = "\n".join(" ".join(x) for x, f in zip(lines, first, strict=True) if f >= i)
    _, got = run(spark, [(i, "\n".join(" ".join(x) for x in lines)) for i, lines in rows.items()])
    assert {i: t for (i, _), t in got.items()} == want


@pytest.mark.parametrize("share", [1, 1024])
def test_hot_lines_are_met_apart(spark, monkeypatch, share):
    """A line of a third of all places, by the broadcast and by the join."""
    monkeypatch.setattr(templates, "HOT_SHARE", share)
    rows = [(i, f"the one line that all of them hold\nown line number w{i} x{i} y{chr(97 + i % 26)}{i}a") for i in range(300)]
    rows += [(i, f"z{chr(97 + i % 5)} z") for i in range(300, 400)]
    _, got = run(spark, rows)
    assert sum("all of them" in t for t in got.values()) == 1
    assert sum(t != "" for (i, _), t in got.items() if i >= 300) == 5
    plan = templates.dropped_lines(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "ArrowEval" not in plan


def test_ids_of_other_kinds(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "four five"), ("c", "four five")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in templates.deduplicate(docs).collect()} == {"a": "one two three", "b": "", None: "four five", "c": ""}
