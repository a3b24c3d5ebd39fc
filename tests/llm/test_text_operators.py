"""Rules, licence scan, chat format and BPE."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlab.llm import bpe, chat_format, license_scan, quality_rules
from tests.llm.fixtures import documents, empty, save

SPACES = r"[^\x20\x09-\x0D]+"


def brute_rules(text):
    words = re.findall(SPACES, text or "")
    windows = [" ".join(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)} if len(words) < 2000 else set()
    lines = [x for x in (text or "").split("\n") if re.search(SPACES, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_match_brute_force(spark):
    got = quality_rules.quality_rules(documents(spark), into="kept").select("doc_id", "text", "n_words", "kept.*").collect()
    assert len(got) == 23
    for r in got:
        s = r["stats"]
        want = brute_rules(r["text"])
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == want
        assert r["n_words"] == -1 and r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"] and not r["failed"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[15] and not kept[16] and not kept[5] and not kept[6]
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    plain = spark.createDataFrame([(1, "It was the first of many days on which the river rose, and nobody in the town had thought of what to do about it until then.")], "doc_id long, text string")
    assert quality_rules.quality_rules(plain).first()["quality"]["kept"]


def test_quality_rules_run_no_python(spark):
    plan = quality_rules.quality_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [i for p in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min(at, default=None), max(at, default=None)


@pytest.mark.parametrize("text", [None, "", "CC-BY cc by cc by", "all rights reserved. All Rights, Reserved", "xgeneral public license", "the GNU General Public\nLicense é", "cc by" * 3, "É CC BY-NC 4.0"])
def test_license_places(text):
    assert license_scan.scan(text)[:4] == brute_scan(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("cc by CC general public license all rights reserved x é 4 - .".split()), max_size=30), st.sampled_from([" ", "-", "\n", ", "]))
def test_license_places_random(parts, sep):
    text = sep.join(parts)
    assert license_scan.scan(text)[:4] == brute_scan(text)


def test_license_expressions():
    parse = lambda x: license_scan.to_postfix(x.lower())
    assert parse("MIT OR GPL-2.0 AND Apache-2.0") == ["mit", "gpl-2.0", "apache-2.0", "and", "or"]
    assert parse("(MIT OR GPL-2.0) AND Apache-2.0 */ more") == ["mit", "gpl-2.0", "or", "apache-2.0", "and"]
    assert parse("GPL-2.0 WITH Classpath-exception OR MIT") == ["gpl-2.0", "classpath-exception", "with", "mit", "or"]
    assert license_scan.evaluate(parse("GPL-2.0 OR MIT")) == ({"gpl", "mit"}, 0.9)
    assert license_scan.evaluate(parse("GPL-2.0 AND MIT")) == ({"gpl", "mit"}, 0.4)
    assert license_scan.evaluate(parse("GPL-2.0 WITH x")) == ({"gpl"}, 0.5)
    for bad in ("", "and mit", "mit or", "(mit"):
        with pytest.raises(ValueError):
            parse(bad)
    assert license_scan.scan("SPDX-License-Identifier: MIT OR")[5:] == ("spdx-malformed", 0.0)
    assert license_scan.scan("// SPDX-License-Identifier: GPL-2.0 OR MIT\n all rights reserved")[4:] == ("reserved", "gpl,mit,reserved", 0.0)


@pytest.mark.parametrize("text, labels, score", [
    ("Licensed under GPL-3.0-or-later", "gpl", 0.4), ("SPDX-License-Identifier: GPL-2.0 OR MIT", "gpl,mit", 0.9), ("SPDX-License-Identifier: GPL-2.0 AND MIT", "gpl,mit", 0.4), ("SPDX-License-Identifier: MITNFA", "mit", 0.9),
    ("/* SPDX-License-Identifier: MIT */ all rights reserved", "mit,reserved", 0.0), ("spdx-license-identifier: ISCX-1", "iscx-1", 0.3), ("iscx mitnfa", "", 0.0), ("SPDX-License-Identifier: CC-BY-4.0", "cc-by", 0.8),
    ("# SPDX-License-Identifier: Apache-2.0\n# see LGPL-2.1", "apache,lgpl", 0.6), ("the GNU General Public License", "gpl", 0.4), ("SPDX-License-Identifier: (MIT\nCC BY-NC 4.0", "cc-by,cc-by-nc,spdx-malformed", 0.0), ("Tous droits réservés", "reserved", 0.0),
])
def test_license_labels(text, labels, score):
    found = license_scan.scan(text)
    assert found[5:] == (labels, score) and found[:4] == brute_scan(text) and set(found[4].split(",")) - {""} <= set(labels.split(","))


def brute_notices(text):
    """Labels and score of a text without tags: every phrase tried at every word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = {label for phrase, label in license_scan.phrases().items() if label for p in [phrase.split()] if any(words[i : i + len(p)] == p for i in range(len(words)))}
    return ",".join(sorted(found)), min((license_scan.FREEDOM[x] for x in found), default=0.0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*sorted({w for p in license_scan.phrases() for w in p.split()} - {"spdx"}), *license_scan.IDENTIFIERS, *license_scan.NOTICES, "x", "\n"]), max_size=12))
def test_license_labels_random(parts):
    text = " ".join(parts)
    assert license_scan.scan(text)[5:] == brute_notices(text)


def test_license_awkward_rows(spark):
    long = "word " * 200_000 + "all rights reserved"
    df = spark.createDataFrame([(1, long), (1, long), (2, None)], "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = df.select("doc_id", "labels", license_scan.license_scan(F.col("text")).alias("s")).select("doc_id", F.col("labels").alias("own"), "s.*").collect()
    assert sorted((r["doc_id"], r["own"], r["first_word"], r["labels"]) for r in got if r["doc_id"] == 1) == [(1, "clash", 200_000, "reserved")] * 2
    assert [(r["n_words"], r["labels"], r["score"]) for r in got if r["doc_id"] == 2] == [(0, "", 0.0)]
    assert df.limit(0).select(license_scan.license_scan(F.col("text")).alias("s")).count() == 0


def test_license_query_labels(spark):
    """The registered query over a given table, row by row against brute force where a text has no tag."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = license_scan.op2_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts) and any(r["labels"] for r in rows)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == brute_scan(texts[r["doc_id"]])
        if "spdx" not in (texts[r["doc_id"]] or "").lower():
            assert (r["labels"], r["score"]) == brute_notices(texts[r["doc_id"]])


def test_license_query(spark, tmp_path):
    d = save(documents(spark), tmp_path, "documents")
    rows = license_scan.op2_license_scan(spark, d).collect()
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert len(rows) == 23 and all(0 <= r["score"] <= 1 and r["n_words"] == brute_scan(texts[r["doc_id"]])[0] for r in rows)


def test_chat_escapes_round_trip():
    for text in ("", "\\", "</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "a\\<|b", "[[INST]]", "<<|", "line\nline"):
        for role in ("user", "assistant", "", "odd\nrole<|"):
            segment, a, b = chat_format.render(role, text)
            assert chat_format.read_segment(segment) == (role, text)
            assert chat_format.unescape(segment[a:b]) == (text if role == "assistant" else "")
            assert not re.search(r"</?s>|\[/?INST\]", segment) and segment.count("<|") == 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|>[/]INSTs\\\nab", max_size=40), st.text(alphabet="<|\\\nu", max_size=5))
def test_chat_round_trip_random(text, role):
    assert chat_format.read_segment(chat_format.render(role, text)[0]) == (role, text)


def test_chat_empty_table_and_long_text(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, parts string, segment string"
    save(spark.createDataFrame([], schema), tmp_path, "conversations")
    assert [r["conv_id"] for r in chat_format.op4_chat_format(spark, str(tmp_path)).collect()] == [-1]
    text = "</s><|end|>\n\\" * 100_000
    turns = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = chat_format.digest_conversations(chat_format.format_turns(turns.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")))).first()
    assert got["loss_chars"] == len(text) and got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_chat_query_on_awkward_rows(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (None, None, "assistant", "x"), (2**60 + 1, 0, "assistant", "</s>")]
    save(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    got = {r["conv_id"]: r for r in chat_format.op4_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == {1, 2, None, -1, 2**60 + 1}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\na\nuser\na\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b")
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0 and got[2**60 + 1]["loss_sha256"] == sha("</s>")
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["loss_chars"] == len(said) and got[-1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n")


def test_typed_parts(spark):
    parts = [("text", "see ", None), ("image", None, "a.png"), ("document", None, None), ("video", None, "v"), ("audio", None, "c.wav"), ("text", None, None), (None, "x = 1", None), None]
    df = spark.createDataFrame([(1, parts), (2, None), (3, [])], "id int, parts array<struct<type:string,text:string,ref:string>>")
    got = {r["id"]: r["f"] for r in df.select("id", chat_format.flatten_parts(F.col("parts")).alias("f")).collect()}
    assert got[1]["text"] == "see <|image:0|><|document:1|><|other:2|><|audio:3|><|other:4|>" and got[1]["refs"] == ["a.png", "", "v", "c.wav", "x = 1"]
    assert got[1]["attachment_tokens"] == 576 + 256 + 256 + 188 + 256 and got[2]["text"] == "" and got[3]["refs"] == []


def test_attachments_reach_the_formatted_turns(spark):
    """Placeholders stay whole, the same characters in a text do not, and control strings split over two text parts are broken."""
    said = lambda *x: [("text", t, None) for t in x]
    rows = [(1, 0, "user", [("text", "see <|image:0|>\\", None), ("image", None, "a.png"), ("text", "<", None), ("text", "|end|>\n</s", None), ("text", ">[INST]", None), ("audio", None, None)])]
    rows += [(1, 1, "assistant", [("document", None, "d.pdf"), ("text", "ok", None)]), (2, 0, "user", said("<|image:0|>")), (3, 0, "user", [("image", None, "a")]), (4, 0, "user", [("image", None, "b")]), (5, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string>>")
    segments = chat_format.format_turns(turns)
    got = {(r["conv_id"], r["turn"]): r for r in segments.collect()}
    body = "see <\\|image:0|>\\\\<|image:0|><\\|end|>\n<\\/s>[\\INST]<|audio:1|>"
    assert got[1, 0]["segment"] == "<|turn|>user\n" + body + "<|end|>\n" and got[1, 0]["refs"] == ["a.png", ""] and got[1, 0]["attachment_tokens"] == 576 + 188
    assert chat_format.read_pieces(got[1, 0]["segment"]) == ("user", ["see <|image:0|>\\", "<|image:0|>", "<|end|>\n</s>[INST]", "<|audio:1|>", ""])
    assert got[2, 0]["segment"] != got[3, 0]["segment"] and chat_format.read_pieces(got[3, 0]["segment"])[1] == ["", "<|image:0|>", ""]
    digest = {r["conv_id"]: r for r in chat_format.digest_conversations(segments).collect()}
    assert (digest[1]["n_attachments"], digest[1]["attachment_tokens"], digest[1]["loss_chars"]) == (3, 576 + 188 + 256, 2)
    assert len({digest[i]["attachments_sha256"] for i in (2, 3, 4)}) == 3 and digest[5]["n_turns"] == 1 and digest[5]["attachment_tokens"] == 0


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(bpe._content(None))


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["the", " the", "ing", "\n\n", "  ", "'re", "=====", "<|endoftext|>", "é", "日本", "1234", "\x85", "　", "aaaa"]), max_size=20).map("".join)))
def test_bpe_equals_the_library(tokenizer, encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == ids and encoder.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False) == text
    assert encoder.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_queries(spark, tmp_path, tokenizer):
    docs = documents(spark)
    d = save(docs, tmp_path, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.op5_bpe(spark, d).collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(docs)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert bpe.digest_texts(empty(spark)).count() == 0
