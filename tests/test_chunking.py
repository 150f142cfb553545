import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import chunking, embedding
from lodestream.operators.chunking import chunks


def spans(text, language):
    return [(c.start_line, c.end_line, c.symbol) for c in chunks(text, language)]


def test_windows():
    assert spans("\n".join(f"line {k}" for k in range(130)), "text") == [(1, 60, None), (51, 110, None), (101, 130, None)]
    assert [(c.start_line, c.end_line, c.content) for c in chunks("a\nb\n", "text")] == [(1, 3, "a\nb\n")]
    assert chunks("", "text") == chunks(None, "java") == chunks("\n \n\t\n", "text") == []


def test_markdown():
    assert spans("intro\n# A\nx\n### C\n## B\ny", "markdown") == [(2, 4, "A"), (5, 6, "B")]
    assert spans("x\n### C\ny", "markdown") == [(1, 3, None)]


def test_symbols():
    assert spans("import os\n\ndef f(x):\n  return x\nclass A:\n  pass", "python") == [(1, 2, None), (3, 4, "f"), (5, 6, "A")]
    assert spans("public static void main(String[] a) {", "java") == [(1, 1, None)]
    assert spans("public void run() {", "java") == [(1, 1, "run")]
    assert spans("fn main() {\n}", "rust") == [(1, 2, "main")]
    assert spans("package x\nfunc (s *S) Go(a int) {", "go") == [(1, 1, None), (2, 2, "Go")]
    assert spans("(defun foo (x) x)", "lisp")[0][:2] == (1, 1)
    assert spans("char *strrev(char *s) {\n}", "c") == [(1, 2, "strrev")]
    assert chunking.symbol_name("class Counter") == "Counter" and chunking.symbol_name("public static") is None


def test_long_lines_are_cut():
    assert [len(c.content) for c in chunks("z" * 3200, "text")] == [1500, 1500, 200]
    assert [c.content for c in chunks("😀" * 1000, "text")] == ["😀" * 750, "😀" * 250]


@pytest.mark.parametrize("seed", range(5))
def test_pieces_give_the_text_again(seed):
    rnd = random.Random(seed)
    text = "\n".join("w" * rnd.choice([0, 3, 80, 900, 4000]) for _ in range(50))
    made = chunks(text, "text")
    assert all(chunking.units(c.content) <= chunking.MAX_CHARS for c in made)
    lines = text.split("\n")
    for c in made:
        assert c.content in "\n".join(lines[c.start_line - 1 : c.end_line])
    pieces = list(chunking.fitted(lines, 0, 49, None))
    assert "".join(p.content for p in pieces).replace("\n", "") == text.replace("\n", "")


def test_on_spark(spark):
    files = spark.createDataFrame([(1, "# A\nx\n# B\ny", "markdown"), (2, None, "text"), (3, "a\nb", "text")], "file_id long, content string, language string")
    rows = chunking.chunked(files, "file_id").orderBy("file_id", "chunk_no").collect()
    assert [(r["file_id"], r["chunk_no"], r["symbol"], r["token_est"]) for r in rows] == [(1, 0, "A", 1), (1, 1, "B", 1), (3, 0, None, 1)]
    text = "\n".join(f"l{k}" for k in range(130))
    windows = spark.createDataFrame([(text,)], "t string").select(F.explode(chunking.line_windows(F.col("t"))).alias("c")).select("c.*").collect()
    assert [(r["start_line"], r["end_line"], r["content"]) for r in windows] == [(c.start_line, c.end_line, c.content) for c in chunks(text, "text")]


class Fussy(embedding.HashingEmbedder):
    """Refuses long batches and long texts."""

    def embed(self, texts):
        if len(texts) > 2 or any(len(t) > 600 for t in texts):
            raise embedding.TooLong
        return super().embed(texts)


def test_embedding(spark):
    assert [len(b) for b in embedding.packed(["a" * 4000, "b" * 4000, "c", "d"], 2, 6000)] == [1, 2, 1]
    model = Fussy(16)
    assert embedding.embed_range(model, ["a b"] * 5 + ["x" * 1100]).shape == (6, 16)
    with pytest.raises(embedding.TooLong):
        embedding.embed_range(model, ["x" * 1300])
    rows = embedding.embedded(spark.createDataFrame([(1, "a b c"), (2, None)], "i int, content string"), embedding.HashingEmbedder(8)).collect()
    assert len(rows[0]["embedding"]) == 8 and sum(x * x for x in rows[0]["embedding"]) == pytest.approx(1) and not any(rows[1]["embedding"])

    class Wrong(embedding.HashingEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:, :3]

    with pytest.raises(Exception, match="vectors of shape"):
        embedding.embedded(spark.createDataFrame([(1, "a")], "i int, content string"), Wrong(8)).collect()
