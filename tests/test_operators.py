import io
import pickle
import random
import struct
import zipfile

from pyspark.sql import functions as F

from millrace.operators import store
from millrace.operators.sequential import sequential
from millrace.plans import catalogue
from millrace.sources import documents, payloads
from millrace.streaming import live, steps

SF = "/root/testdata/sf0.001"


def test_sequential_steps(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.getrandbits(12), float(i * rng.randint(0, 3))) for k in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, i int, hash long, at double")
    got = {(r.k, r.i): (r.distance, r.changed) for r in sequential(df, ["k"], ["i"], steps.change_step(5), "distance int, changed boolean").collect()}
    for k in range(4):
        base = None
        for kk, i, h, _ in rows:
            if kk == k:
                dist = None if base is None else (base ^ h).bit_count()
                assert got[(k, i)] == (dist, dist is None or dist >= 5)
                base = h if dist is None or dist >= 5 else base


def test_steps():
    ring = steps.ring_step(0.9, 2, 300)
    state, out = ring(None, {"text": "a b", "at": 0})
    assert not out["duplicate"]
    state, out = ring(state, {"text": "B A", "at": 10})
    assert out["duplicate"]
    assert not ring(state, {"text": "a b", "at": 400})[1]["duplicate"]
    add = steps.append_step()
    state, _ = add(None, {"text": "first line of the text that is stored"})
    assert add(state, {"text": "first line of the text that is stored"})[1]["action"] == "skipped"
    more = "an entirely different sentence with many unseen expressions in it"
    new, out = add(state, {"text": more})
    assert out == {"action": "updated", "n_added": len(more), "stored_hash": steps.sha(f"first line of the text that is stored\n\n{more}")} and more in new.lines
    kept = steps.append_step(keep=True)
    state, _ = kept(None, {"text": "first line of the text that is stored"})
    again = pickle.loads(pickle.dumps(kept(state, {"text": more})[0]))
    assert again.hash.hexdigest() == out["stored_hash"] and again.lines == new.lines and again.words == new.words
    ttl = steps.dedup_step(10)
    state, out = ttl(None, {"content_hash": "x", "at": 0})
    assert out["action"] == "created" and ttl(state, {"content_hash": "x", "at": 5})[1]["action"] == "skipped" and ttl(state, {"content_hash": "x", "at": 50})[1]["action"] == "created"


def test_snapshot_merges(spark):
    df = spark.createDataFrame([(0, "u1", "one"), (1, "u1", "one"), (2, "u1", "two words"), (3, "u2", "")], "seq int, url string, text string")
    p = store.payloads(df, F.lit("web"), F.col("url"), F.col("text"), F.col("seq"))
    assert [r.action for r in store.actions(p).orderBy("seq").collect()] == ["created", "skipped", "updated", "created"]
    sources, chunks = store.snapshot(p)
    assert {(r.source_path, r.chunk_count) for r in sources.collect()} == {("u1", 1), ("u2", 0)}
    new = chunks.withColumn("chunk_text", F.lit("new"))
    assert sorted((r.chunk_text, r.is_deleted) for r in store.replace_chunks(chunks, new).collect()) == [("new", False), ("two words", True)]
    assert sorted(r.chunk_index for r in store.append_chunks(chunks, new).collect()) == [0, 1]
    left, marked = store.delete(sources, chunks, sources.where("source_path = 'u1'"))
    assert left.count() == 1 and marked.where("is_deleted").count() == 1
    assert store.reconstruct(store.append_chunks(chunks, new)).first().content == "two words\n\nnew"


def test_commit_and_read_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    store.commit(spark, root, {"t": spark.range(3)})
    store.commit(spark, root, {"t": spark.range(5)})
    assert store.current(spark, root, "t").count() == 5
    q = store.changes(spark, root).writeStream.format("memory").queryName("versions").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp"))
    q.start().awaitTermination(60)
    assert spark.table("versions").count() == 2


def test_payload_lines_and_frames(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source":"s","url":"u","content":"c","extra":1}\nnot json\n{"source":"s","url":"u"}\n')
    rows = payloads.read_payloads(spark, str(tmp_path / "a.jsonl")).collect()
    assert [r.error is None for r in rows] == [True, False, False] and rows[2].error == "Parse error: missing content"
    frame = lambda b: struct.pack("<I", len(b)) + b
    assert payloads.split_frames(frame(b"{}") + frame("é".encode()) + struct.pack("<I", 0) + frame(b"x")) == ["{}", "é"]
    assert payloads.split_frames(frame(b"abc") + b"\x05\x00\x00\x00ab") == ["abc"]
    (tmp_path / "m.bin").write_bytes(frame(b'{"type":"content","content":"hi"}') + frame(b'{"type":"ping"}'))
    m = payloads.extension_messages(payloads.read_frames(spark, str(tmp_path / "m.bin"))).collect()
    assert [(r.content, r.app_name) for r in m] == [("hi", "Chrome")]


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels.xml", "_rels.xml"), body)
    return out.getvalue()


def test_office_readers():
    w = documents.W[1:-1]
    raw = zipped(word__document_xml=f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert documents.docx_text(raw) == "Hello\na\tb"
    slide = lambda t: f'<s xmlns:a="x"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></s>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in ((10, "ten"), (2, "two")):
            z.writestr(f"ppt/slides/slide{n}.xml", slide(t))
    assert documents.pptx_text(out.getvalue()) == "=== Slide 1 ===\ntwo\n\n=== Slide 2 ===\nten"
    assert [documents.number_text(x) for x in (3.0, 0.00001234, 1.23456, 12345678901.5)] == ["3", "1.2340e-5", "1.2346", "1.2346e10"]
    s, r = documents.S[1:-1], documents.R[1:-1]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<x><y Id="r1" Target="worksheets/sheet1.xml"/></x>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>a\tb</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row><c r="A2"/></row></sheetData></worksheet>')
    assert documents.xlsx_text(out.getvalue()) == "# Sheet 1: One\n# Rows: 1\n\na    b\t\t2.5"


def test_page_text():
    html = "<html><head><title> T  t</title><meta name='description' content='D'></head><body><nav>no</nav><article>yes <b>this</b><div class='ad x'>no</div><br>end</article><p>out</p></body></html>"
    assert documents.page_text(html) == ("T t", "D\n\nyes this end")
    assert documents.page_text("<p>only &amp; body<script>x</script>") == ("", "only & body")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, f"h{i // 2 % 3}", float(i)) for k in ("a", "b") for i in range(8)]
    df = spark.createDataFrame(rows, "path string, seq int, content_hash string, at double")
    folder = str(tmp_path / "in")
    df.where("seq < 4").coalesce(1).write.json(folder)
    df.where("seq >= 4").coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).json(folder)
    q = live.keyed(stream, ["path"], ["seq"], steps.dedup_step(), "action string").writeStream.format("memory").queryName("dedup_out").outputMode("append").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(120)
    got = {(r.path, r.seq): r.action for r in spark.table("dedup_out").collect()}
    want = {(r.path, r.seq): r.action for r in sequential(df, ["path"], ["seq"], steps.dedup_step(), "action string").collect()}
    assert got == want


def test_every_query_runs(spark):
    for name in ("change_detect", "near_ring", "ocr_append", "generic_page", "redact_cards", "display_assign", "page_sources"):
        assert catalogue.QUERIES[name](spark, SF).count() > 0, name
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
