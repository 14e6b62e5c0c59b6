"""The typed split, tokenizers and the split by meaning."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import semantic, tokens
from tarn.functions.typed_split import Chunk, gathered, is_told_dialogue, typed_split, with_paths
from tarn.plans import ingest
from tarn.providers import Offline

TABLE = "| tide | hour |\n|---|---|\n| high | 6 |\n| low | 12 |"
CODE = "```sh\nmake all\n```"
#: Text, and the (type, text) of its chunks; a text of one piece is written once.
CASES = {
    "blank": (" \n\t\n", []),
    "dividers alone": ("---\n\n***\n-*-", []),
    "prose of several paragraphs is one": ("The tide came in.\n\nIt went out again.", [("content", "The tide came in.\n\nIt went out again.")]),
    "equals signs are prose": ("The tide\n====\nwent out.", [("content", "The tide\n====\nwent out.")]),
    "a mixed divider parts": ("The tide came.\n\n-*-\n\nIt went.", [("content", "The tide came."), ("content", "It went.")]),
    "a list stays whole": ("- salt\n- rope\n\n- tar", [("list", "- salt\n- rope\n\n- tar")]),
    "a quote stays whole": ('"Row on."\n— a cook', [("quote", '"Row on."\n— a cook')]),
    "a table without gaps stays whole": (TABLE, [("table", TABLE)]),
    "a transcript stays whole": ("Ada:\nshall we go\nBen:\nyes we shall\n\nAda:\nnow", [("transcript", "Ada:\nshall we go\nBen:\nyes we shall\n\nAda:\nnow")]),
    "code without gaps stays whole, under a heading too": ("# Run\nmake all\ngit pull\npip install x\nx = 1", [("code", "# Run\nmake all\ngit pull\npip install x\nx = 1")]),
    "prose with a table": (f"The hours are these.\n\n{TABLE}\n\nMind them.", [("content", "The hours are these."), ("table", TABLE), ("content", "Mind them.")]),
    "prose with a paragraph of code": (
        "Here is how the harbour is built from what lies in the yard.\nThe pier comes first and then the wall, and last of all the light.\n\nmake all\ngit pull\ndocker run x",
        [("content", "Here is how the harbour is built from what lies in the yard.\nThe pier comes first and then the wall, and last of all the light."), ("code", "make all\ngit pull\ndocker run x")],
    ),
    "an open fence runs to the end": ("Words come first.\n\n```\nx\n\n# not a heading", [("content", "Words come first."), ("code", "```\nx\n\n# not a heading")]),
    "fences of json": ('Words come first.\n\n```JSON\n{"a": 1}\n```\n\n```jsonc\n{}\n```', [("content", "Words come first."), ("json", '```JSON\n{"a": 1}\n```'), ("code", "```jsonc\n{}\n```")]),
    "headings go with what they head": ("# Sea\n\n## Boats\n\nThey float.\n\nAnd sail.", [("content", "# Sea\n\n## Boats\n\nThey float.\n\nAnd sail.")]),
    "a heading begins anew": ("# Sea\n\nIt is wide.\n\n# Land\n\nIt is dry.", [("content", "# Sea\n\nIt is wide."), ("content", "# Land\n\nIt is dry.")]),
    "headings of falling depth": ("# A\n\n## B\n\n### C\n\n## D\n\nText of d.", [("heading_only", "# A\n\n## B\n\n### C"), ("content", "# A\n\n## D\n\nText of d.")]),
    "sibling headings without text": ("# A\n\n# B\n\n# C", [("heading_only", "# A\n\n# B\n\n# C")]),
    "runs of headings name each once": ("Intro text.\n\n# A\n\n## B\n\n## C\n\n## C", [("content", "Intro text."), ("heading_only", "# A\n\n## B\n\n## C")]),
    "headings that open a document stand before its table": (f"# Tides\n\n{TABLE}", [("heading_only", "# Tides"), ("table", TABLE)]),
    "later headings go with the table": (f"Words.\n\n# Tides\n\n{TABLE}\n\nMore.", [("content", "Words."), ("table", f"# Tides\n\n{TABLE}"), ("content", "More.")]),
    "a last heading stands alone": ("Text of it.\n\n# End", [("content", "Text of it."), ("heading_only", "# End")]),
    "lists far apart are gathered, and the prose around them": (
        "# Stores\n\nWe need these things for the trip that begins tomorrow.\n\n- salt\n- rope\n\nAnd then, from the other shop in the town, these.\n\n- tar\n- oil\n\nThat is all that we need.",
        [("content", "# Stores\n\nWe need these things for the trip that begins tomorrow.\n\nAnd then, from the other shop in the town, these.\n\nThat is all that we need."), ("list", "- salt\n- rope\n\n- tar\n- oil")],
    ),
    "with subsections nothing is gathered": (
        "# Stores\n\nWe need these.\n\n- salt\n- rope\n\n## More\n\nAnd these.\n\n- tar\n- oil",
        [("content", "# Stores\n\nWe need these."), ("list", "- salt\n- rope"), ("content", "## More\n\nAnd these."), ("list", "- tar\n- oil")],
    ),
    "with code the prose is not gathered": (
        f"# Stores\n\nWe need these.\n\n- salt\n- rope\n\n{CODE}\n\nAnd these.\n\n- tar\n- oil",
        [("content", "# Stores\n\nWe need these."), ("list", "- salt\n- rope\n\n- tar\n- oil"), ("code", CODE), ("content", "And these.")],
    ),
    "lists of both types take the first's": ("# Do\n\nFirst the words.\n\n1. row\n2. sail\n\nThen the rest.\n\n- eat\n- sleep", [("content", "# Do\n\nFirst the words.\n\nThen the rest."), ("structured_list", "1. row\n2. sail\n\n- eat\n- sleep")]),
    "a told dialogue": ("Words.\n\n---\n\nThey spoke like this:\nAnna asked for the boat.\nPeter gave it away.", [("content", "Words."), ("transcript", "They spoke like this:\nAnna asked for the boat.\nPeter gave it away.")]),
    "under a heading it is prose": ("# Pier\n\nThey spoke like this:\nAnna asked for the boat.\nPeter gave it away.", [("content", "# Pier\n\nThey spoke like this:\nAnna asked for the boat.\nPeter gave it away.")]),
    "turns of a dialogue with code between": (
        f"Ada:\nshall we go\n\nBen:\nyes we shall\n\n{CODE}\n\nCid:\nthen let us go now",
        [("transcript", "Ada:\nshall we go\n\nBen:\nyes we shall\n\nCid:\nthen let us go now"), ("code", CODE)],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    text, want = CASES[name]
    assert [(c.kind, c.text) for c in typed_split(text)] == want


def test_nothing_of_a_text_is_lost():
    """Texts of blocks in any order: each block's words come out once, in order where nothing is gathered."""
    r = random.Random(7)
    pieces = ["# One", "## Two", "### Three", "Plain words here.", "More plain words there.", "- a\n- b", "1. x\n2. y", TABLE, CODE, '```json\n{"k": 1}\n```', "> said\n> again", "---", "Ada:\nhello you", "Ben:\nhello too", "Q: why\nA: so", "Keel: a spine\nBoom: a spar"]
    for _ in range(600):
        chosen = [f"{r.choice(pieces)}" for _ in range(r.randint(1, 9))]
        text = "\n\n".join(chosen)
        out = "\n".join(c.text for c in typed_split(text))
        for block in chosen:
            if block != "---":
                assert block in out
        for block in set(chosen) - {"---"}:
            if not block.startswith("#"):
                assert out.count(block) >= chosen.count(block)


def test_gathers_and_paths():
    a, b, c = Chunk("x", "list"), Chunk("y", "content"), Chunk("z", "list")
    assert gathered([a, b, c], lambda x: x.kind == "list") == [Chunk("x\n\nz", "list"), b]
    assert gathered([a, b], lambda x: x.kind == "list", "transcript") == [a, b]
    paths = [x.path for x in with_paths([Chunk("# A\n\n### C\n\ntext", "content"), Chunk("## B", "content"), Chunk("words", "content"), Chunk("# D", "heading_only")])]
    assert paths == ["A > C", "A > B", "A > B", "D"]
    assert not is_told_dialogue("So:\nAnna said.") and not is_told_dialogue("So:\nAnna said it.\n- Peter too.\nCid said.") and not is_told_dialogue("So\nAnna said.\nPeter too.")
    assert is_told_dialogue("So:\n\nAnna said it.\nor so\nPeter too.")


def test_typed_chunks_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, CASES["headings of falling depth"][0]), (None, "one"), (None, "one"), (4, None), (5, "x. " * 50_000)], "doc_id long, text string")
    chunks = ingest.typed_chunks(docs)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" not in ingest.document_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    rows = chunks.collect()
    assert sorted([(r["doc_id"], r["chunk_index"], r["total"]) for r in rows], key=str) == sorted([(1, 0, 2), (1, 1, 2), (None, 0, 1), (None, 0, 1), (5, 0, 1)], key=str)
    assert chunks.where("doc_id IS NULL").first()["path"] == "" and ingest.typed_chunks(docs.limit(0)).count() == 0


# -- tokens ------------------------------------------------------------------------------------------------------


def plain_pairs(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    if word in ranks:
        return [word]
    while len(parts) > 1:
        best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


def small_ranks(seed=1):
    """A vocabulary of all bytes and of joined pairs of a few letters."""
    r, out = random.Random(seed), [bytes([i]) for i in range(256)]
    while len(out) < 420:
        x = r.choice(out[97:102] + out[256:]) + r.choice(out[97:102] + out[256:])
        if x not in out and len(x) < 9:
            out.append(x)
    return {x: i for i, x in enumerate(out)}


def test_pairs_are_joined_as_by_the_plain_loop():
    ranks, r = small_ranks(), random.Random(3)
    t = tokens.BytePairs(ranks)
    for _ in range(2000):
        word = "".join(r.choice("abcdeé") for _ in range(r.randint(1, 40))).encode()
        ends = t.ends(word)
        assert [word[a:b] for a, b in zip([0, *ends], ends, strict=False)] == plain_pairs(word, ranks)
    assert t.ends(b"") == [] and t.count("") == 0 and t.count("abcde" * 20_000) > 0


def test_tokens_equal_a_public_library(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    with open(public.path("byte_bpe_50k.tiktoken")) as f:
        lines = f.read().splitlines()
    (tmp_path / "ranks").write_text("\n".join(lines) + "\n")
    own = tokens.byte_pairs(spark, str(tmp_path / "ranks"))
    theirs = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(5)
    texts = ["", " ", "The tide\n\ncame in, at 6:30 o'clock; it's 42,000 waves.", "Überfähre naïve 日本語 😀😀 \t\r\n  x", "a" * 3000, "<|endoftext|>"] + ["".join(r.choice(" aetionsrhé.,!\n'1Z日") for _ in range(r.randint(1, 90))) for _ in range(800)]
    for x in texts:
        want = theirs.encode_ordinary(x)
        assert own.encode(x) == want and own.count(x) == len(want)
        for size, overlap in ((7, 0), (5, 2)):
            step, clean = size - overlap, x.strip()
            ids = theirs.encode_ordinary(clean)
            starts = [0] if len(ids) <= size else [s for s in range(0, len(ids), step) if s == 0 or s - step + size < len(ids)]
            parts = [theirs.decode(ids[s : s + size]).strip() for s in starts]
            assert own.windows(x, size, overlap) == [p for p in parts if p]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts[:50])] + [(99, None)], "i int, t string")
    got = {r["i"]: (r["n"], r["w"]) for r in df.select("i", tokens.token_count(own, F.col("t")).alias("n"), tokens.token_windows(own, F.col("t"), 4).alias("w")).collect()}
    assert got[99] == (0, []) and all(got[i] == (own.count(x), own.windows(x, 4)) for i, x in enumerate(texts[:50]))


def test_words_and_their_windows():
    t = tokens.Words()
    assert t.count("One two, three!") == 5 and t.windows("One two, three!", 9) == ["One two, three!"] and t.windows(" ", 3) == []
    assert t.windows("One two, three!", 2) == ["One two", ", three", "!"] and t.windows("a b c d e", 3, 1) == ["a b c", "c d e"]


# -- meaning -----------------------------------------------------------------------------------------------------


def sentences_of(topics, r):
    words = {"sea": "tide wave boat sail foam salt reef gull".split(), "bread": "oven flour yeast crust dough rye loaf bake".split()}
    return [" ".join(r.choices(words[t], k=6)).capitalize() + "." for t, n in topics for _ in range(n)]


def plain_breaks(found, embed, percentile):
    """Each sentence with its neighbours, one by one."""
    vectors = [embed([" ".join(found[max(0, i - 1) : i + 2])])[0].astype(float) for i in range(len(found))]
    d = [1 - float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) for a, b in itertools.pairwise(vectors)]
    limit = np.percentile(d, percentile)
    parts, held = [], []
    for i, s in enumerate(found):
        held.append(s)
        if i < len(d) and d[i] > limit:
            parts.append(" ".join(held))
            held = []
    return [*parts, " ".join(held)] if held else parts


@pytest.mark.parametrize("percentile", [47, 83, 95])
def test_breaks_equal_the_plain_version(percentile):
    r = random.Random(percentile)
    embed = Offline(dim=32).splitter().embed
    split = semantic.Splitter(embed=embed, most=160, percentile=percentile)
    texts = [sentences_of([("sea", r.randint(5, 12)), ("bread", r.randint(5, 12))], r) for _ in range(30)]
    got = split.prose([" ".join(t) for t in texts])
    for t, parts in zip(texts, got, strict=True):
        want = plain_breaks(t, embed, percentile)
        assert parts == (want if len(want) > 1 else split.by_runs(t, split.tokenizer.count(" ".join(t))))
        assert " ".join(parts) == " ".join(t)


def test_a_turn_of_meaning_is_found():
    r = random.Random(1)
    t = sentences_of([("sea", 10), ("bread", 10)], r)
    parts = semantic.Splitter(embed=Offline(dim=64).splitter().embed, most=160, percentile=95).prose([" ".join(t)])[0]
    assert len(parts) == 2 and abs(len(semantic.sentences(parts[0])) - 10) <= 1


def test_a_failed_batch_and_those_soon_after_fall_back():
    clock, asked = [0.0], []

    def embed(texts):
        asked.append(len(texts))
        if clock[0] == 0.0:
            raise TimeoutError("no answer")
        return np.eye(len(texts))

    cooldown = semantic.Cooldown(lambda: clock[0])
    split = semantic.Splitter(embed=embed, most=96, seconds=60.0)
    text = " ".join(sentences_of([("sea", 12)], random.Random(2)))
    by_runs = split.by_runs(semantic.sentences(text), split.tokenizer.count(text))
    assert split.prose([text, "short"], cooldown) == [by_runs, ["short"]] and cooldown.failures == 1
    clock[0] = 59.0
    assert split.prose([text], cooldown) == [by_runs] and len(asked) == 1 and cooldown.skipped == 1
    clock[0] = 61.0
    split.prose([text], cooldown)
    assert len(asked) == 2 and cooldown.failures == 1


def test_windows_keep_the_budget():
    split = semantic.Splitter(most=30)
    rows = "\n".join(f"| k{i} | v |" for i in range(6))
    parts = split.windows(f"| a | b |\n|---|---|\n{rows}")
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|") for p in parts) and all(f"| k{i} | v |" in "\n".join(parts) for i in range(6))
    fenced = "```\n" + "x = 1\n" * 30 + "```"
    assert fenced in split.windows(f"Words before it go on.\n{fenced}\nWords after it go on.")
    split = semantic.Splitter(most=12)
    long = " ".join(f"w{i}" for i in range(40))
    parts = split.windows(f"One two three. {long}. Four five six. Seven eight.")
    assert all(split.fits(p) for p in parts) and " ".join(parts).split()[:3] == ["One", "two", "three."]
    assert split.windows(" ") == [] and split.windows("One.") == ["One."]
    whole = semantic.Splitter(embed=Offline(dim=32).splitter().embed, most=40).whole(" ".join(sentences_of([("sea", 8), ("bread", 8)], random.Random(3))))
    assert len(whole) > 1 and all(semantic.Splitter(most=40).fits(p) for p in whole)


def test_document_chunks(spark):
    r = random.Random(4)
    prose = " ".join(sentences_of([("sea", 14), ("bread", 14)], r))
    docs = spark.createDataFrame([("a", f"# Log\n\n{prose}\n\n## Lists\n\n- a\n- b\n\n1. c\n2. d\n\nhar-\nbour"), ("b", None), ("c", " ")], "doc_id string, text string")
    rows = ingest.document_chunks(docs, splitter=semantic.Splitter(embed=Offline(dim=64).splitter().embed, most=320)).orderBy("chunk_index").collect()
    assert [x["chunk_index"] for x in rows] == list(range(len(rows))) and {x["total"] for x in rows} == {len(rows)} and {x["doc_id"] for x in rows} == {"a"}
    logs = [x for x in rows if x["path"] == "Log"]
    assert len(logs) == 3 and logs[0]["text"].startswith("# Log\n\n") and any("harbour" in x["text"] for x in rows)
    lists = [x for x in rows if x["path"] == "Log > Lists" and x["chunk_type"] in ("list", "structured_list")]
    assert len(lists) == 1 and "- b\n\n1. c" in lists[0]["text"]


def test_providers_count_by_their_tokenizer(spark):
    p = Offline(tokenizer=tokens.BytePairs(small_ranks()))
    assert spark.range(1).select(p.count_tokens(F.lit("abc abc")).alias("n")).first()["n"] == p.splitter().tokenizer.count("abc abc")
    assert Offline(by_meaning=False).splitter().embed is None


def test_token_windows_query_equals_a_public_library(spark):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    from tarn import queries

    theirs = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=queries.tokenizer(spark).ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.token_windows(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["tokens"] == len(theirs.encode_ordinary(texts[r["doc_id"]]))
        ids, parts, at = theirs.encode_ordinary(texts[r["doc_id"]].strip()), [], 0
        while True:
            parts.append(theirs.decode(ids[at : at + 400]).strip())
            if at + 400 >= len(ids):
                break
            at += 360
        parts = [p for p in parts if p]
        assert (r["windows"], r["windows_sha256"]) == (len(parts), hashlib.sha256("\n".join(parts).encode()).hexdigest())
