import re
from collections import Counter

from spanloom.llm import quality_rules as q
from tests.llm.helpers import awkward, labels, same_values, write_tables

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(map(text.count, q.SYMBOLS)), len(lines) - len(set(lines)), len(covered)


def _base(df):
    return q.with_statistics(df).select("row.doc_id", "row.text", *[f"s.{n}" for n in NAMES])


def test_statistics_on_all_documents(spark, sf):
    for r in _base(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        assert tuple(r[n] for n in NAMES) == brute(r["text"])


def test_statistics_of_awkward_and_repetitive_texts(spark):
    more = spark.createDataFrame([(1, "a b c a b c a"), (2, "x x x x x x"), (3, "a b\n a b \n\na b\n#<>&|%$*"), (4, "a b c d a b c")], "doc_id long, text string")
    for df in (awkward(spark), more):
        got = _base(df).collect()
        assert len(got) == df.count()
        for r in got:
            assert tuple(r[n] for n in NAMES) == brute(r["text"])


def test_rules_are_learned_and_precise(spark):
    clean = [(k, " ".join(f"w{k}x{i}" for i in range(60 + k % 40)), 1) for k in range(150)]
    noisy = [(1000 + k, " ".join(f"w{k}x{i}%" for i in range(60 + k % 40)), 0) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in clean + noisy], "doc_id long, text string")
    rules = q.learn(docs, labels(spark, [(d, y, 0) for d, _, y in clean + noisy]))
    assert rules and any(x.feature == "symbol_rate" for x in rules[0])
    kept = {r["doc_id"]: r["__kept"] for r in q.judge(docs, rules).collect()}
    assert all(kept[d] == bool(y) for d, _, y in clean + noisy)
    some = q.judge(docs, rules).where("__kept")  # a filter above is not pushed into the statistics
    assert some.count() == len(clean)


def test_without_labels_base_rules_decide(spark, tmp_path):
    df = awkward(spark)
    folder = write_tables(df, labels(spark), str(tmp_path))
    out = q.op2_quality_rules(spark, folder)
    assert out.count() == df.count()
    assert all(r["kept"] == (not r["base_failed"]) for r in out.collect())
    empty = write_tables(df.limit(0), labels(spark, [(1, 0, 0)]), str(tmp_path / "none"))
    assert q.op2_quality_rules(spark, empty).count() == 0


def test_native(spark, sf):
    plan = q.op2_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_callers_columns_pass_through(spark):
    df = awkward(spark)
    out = q.judge(df, [(q.Literal("symbol_rate", True, 0.2),)])
    assert out.columns == [*df.columns, "__s_", "__base_failed_", "__kept_"] and same_values(df, out)
    assert q.judge(df.limit(0), []).count() == 0


def plain_features(text):
    """The features that rules test, from their definition."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n_lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    per_word, per_line = max(1, n_words), max(1, n_lines)
    return {
        "n_words": n_words, "mean_word": word_chars / per_word, "symbol_rate": n_symbols / per_word, "duplicate_lines": n_dup_lines / per_line,
        "repeated_words": n_repeat / per_word, "distinct_words": len(set(words)) / per_word, "exclamation_rate": (text or "").count("!") / per_word,
        "words_per_line": n_words / per_line,
    }


def test_learned_verdicts_against_a_plain_reading_of_the_list(spark):
    """The rules that the labels of a table teach, read one after another for each document."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rules = q.learn(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"))
    assert rules
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in q.op2_quality_rules(spark, sf).collect()}
    for d, text in docs.collect():
        f = plain_features(text)
        failed = f["n_words"] < 50 or 100 * brute(text)[4] > 50 * f["n_words"]
        dropped = any(all((f[x.feature] > x.cut) == x.above for x in rule) for rule in rules)
        assert got[d] == (failed, not failed and not dropped)
