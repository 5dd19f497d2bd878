import re

from retentio.llm import quality as Q
from tests.llm.conftest import messy_rows


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered if covered is None else len(covered)


def test_base_equals_brute_force(messy):
    got = sorted(((r.doc_id, *r[1:6]) for r in Q.clean_lines(messy).collect()), key=repr)
    want = sorted(((i, *brute_base(t)) for i, t, *_ in messy_rows()), key=repr)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and w[5] in (None, g[5])


def test_rules():
    rule = lambda line, again=False: Q.failing_rule(line, len(line.split()), sum(line.count(c) for c in "#*$%&|<>"), again)
    assert rule("Of%%% the*** and&&& this$$$") == "punctuation"
    assert rule("word " * 25) == "punctuation"
    assert rule("Home » News » Sport » More of this") == "navigation"
    assert rule("Skip to main content.") == "navigation"
    assert rule("All rights reserved by someone.") == "boilerplate"
    assert rule("A plain sentence, nothing else.") is None
    assert rule("A plain sentence, nothing else.", True) == "repetition"


def test_cleaning_and_verdict():
    good = "\n".join(" ".join(f"word{i}x{k}" for k in range(9)) + ", and it ends well." for i in range(8))
    *_, failed, kept, cleaned, lost = Q.judge(good + "\nAll rights reserved.")
    assert not failed and kept and cleaned == good and lost == 3
    junk = "\n".join(" ".join(f"w{i}x{k}###" for k in range(20)) for i in range(20))
    *_, failed, kept, _, _ = Q.judge(good + "\n" + junk)
    assert not failed and not kept


def test_messy_and_empty(messy, empty):
    rows = {r.doc_id: r for r in Q.clean_lines(messy).where("doc_id < 8").collect()}
    assert rows[4].n_words == rows[5].n_words == rows[6].n_words == 0
    assert rows[4].base_failed and not rows[4].kept
    assert Q.clean_lines(messy).count() == len(messy_rows())
    assert Q.clean_lines(empty).collect() == []


def test_quality_labels(spark, sf_dir):
    """Every text marked bad is rejected, every one marked good is kept unless the base rules fail it."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for r in Q.op5_clean_lines(spark, sf_dir).collect():
        if r.doc_id in labels:
            assert r.kept == (labels[r.doc_id] == 1 and not r.base_failed)
