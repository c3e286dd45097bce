import gzip
import json

import pytest
from pyspark.sql import functions as F

from textscore.operators import bpe
from textscore.session import pin_small, scratch_path, spread_small
from textscore.sources import readers, writers
from textscore.sources.schemas import ALL_REVIEW_SCHEMA, REVIEW_SCHEMA
from textscore.streaming import running
from textscore.streaming.running import running_confusion_stream


def put(path, text, opener=open):
    with opener(path, "wt", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def reviews(n, start=0):
    return [{"reviewText": f"text {i}", "overall": 1.0 + i % 5, "asin": "x"} for i in range(start, start + n)]


def test_load_reviews_arrays(spark, tmp_path):
    rows = reviews(4) + [{"reviewText": None, "overall": 3.0}, {"reviewText": "no score"}]
    a = put(tmp_path / "books.json", json.dumps(rows, indent=4))
    b = put(tmp_path / "gift_cards.json", json.dumps(reviews(2, 10)))
    c = put(tmp_path / "old.backup.json", json.dumps(reviews(2, 20)))
    got = sorted((r.type, r.reviewText) for r in readers.load_reviews(spark, [a, b, c]).collect())
    assert got == [("books", f"text {i}") for i in range(4)] + [("gift_cards", "text 10"), ("gift_cards", "text 11")]


def test_array_and_vocabulary_files_are_bounded(spark, sf, monkeypatch):
    from textscore.plans import sources

    whole = {name: sorted(map(str, getattr(sources, name)(spark, sf).collect())) for name in ("load_reviews_arrays", "vocab_load_json")}
    monkeypatch.setattr(sources, "ARRAY_BYTES", 4000)
    monkeypatch.setattr(sources, "VOCAB_WORDS", 50)
    for name, rows in whole.items():
        assert rows and sorted(map(str, getattr(sources, name)(spark, sf).collect())) == rows
    arrays = spark.read.text(sources._array_files(spark, sf)).select(F.length("value").alias("n"), "file", "part")
    assert arrays.groupBy("file").count().agg(F.max("count")).first()[0] > 1
    words = spark.read.schema("model struct<vocab: map<string,int>>").json(sources._vocab_files(spark, sf))
    assert words.count() > 1 and words.agg(F.max(F.size("model.vocab"))).first()[0] < 120


def test_load_reviews_jsonl_first_rows(spark, tmp_path):
    files = [
        put(tmp_path / f"{name}-5core.json", "\n".join(json.dumps(r) for r in reviews(n)) + "\n")
        for name, n in (("books", 5000), ("fashion", 3))
    ]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = readers.load_reviews_jsonl(spark, files, nrows_per_type=1234).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.reviewText for r in rows if r.type == "books"} == {f"text {i}" for i in range(1234)}
    assert len(rows) == 1237
    assert readers.load_reviews_jsonl(spark, files).count() == 5003


@pytest.mark.parametrize("arrays", [True, False])
def test_all_fields_are_read_by_default(spark, tmp_path, arrays):
    rows = [r | {"verified": i % 2 == 0, "style": {"Format:": " CD"}, "image": ["u"], "unixReviewTime": i} for i, r in enumerate(reviews(3))]
    text = json.dumps(rows) if arrays else "\n".join(map(json.dumps, rows))
    got = readers.load_reviews(spark, [put(tmp_path / "books.json", text)], arrays=arrays)
    assert set(got.columns) == {*ALL_REVIEW_SCHEMA.names, "type"}
    found = got.where("reviewText = 'text 2'").select("asin", "verified", "style", "image", "unixReviewTime", "vote", "type").first()
    assert tuple(found) == ("x", True, {"Format:": " CD"}, ["u"], 2, None, "books")
    two = readers.load_reviews(spark, [put(tmp_path / "books.json", text)], REVIEW_SCHEMA, arrays=arrays)
    assert set(two.columns) == {"reviewText", "overall", "type"} and two.count() == 3
    if not arrays:
        plan = got.select("reviewText", "type")._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<reviewText:string,overall:double>" in plan


def test_read_gzip_jsonl(spark, tmp_path):
    path = put(tmp_path / "books.json.gz", "\n".join(json.dumps(r) for r in reviews(50)), gzip.open)
    got = sorted(r.reviewText for r in readers.read_gzip_jsonl(spark, path, 7).collect())
    assert got == sorted(f"text {i}" for i in range(7))


HEAD = "essay_id\tessay_set\tessay\tdomain1_score\tdomain2_score\n"


def test_load_essays(spark, tmp_path):
    train = tmp_path / "train.tsv"
    train.write_bytes((HEAD + '1\t1\t"Caf\xe9 @CAPS1, ""so"""\t8\t\n2\t3\tplain\t0\t2\n3\t1\tx\t\t\n').encode("latin-1"))
    test = tmp_path / "test.tsv"
    test.write_bytes((HEAD + "9\t2\tunseen\t\t\n").encode("latin-1"))
    rows = readers.load_essays(spark, train=str(train), test=str(test)).orderBy("essay_id").collect()
    assert [(r.essay_id, r.essay, r.domain1_score, r.split) for r in rows if r.split == "test"] == [(9, "unseen", None, "test")]
    assert [(r.essay_id, r.essay_set, r.domain1_score, r.essay) for r in rows if r.split == "train"][:1] == [
        (1, 1, 2, 'Café @CAPS 1, "so"')
    ]
    with pytest.raises(ValueError):
        readers.load_essays(spark)




def test_load_essays_json(spark, tmp_path):
    rows = [{"essay_id": "1", "essay_set": "2", "essay": "@NUM1 a", "domain1_score": "5"},
            {"essay_id": "2", "essay_set": "2", "essay": "b", "domain1_score": "<NA>"}]
    path = put(tmp_path / "train_set.json", json.dumps(rows))
    got = readers.load_essays_json(spark, {"train": path}).collect()
    assert [(r.essay_id, r.essay, r.domain1_score, r.split) for r in got] == [(1, "@NUM 1 a", 5, "train")]


def test_category_allowlist(spark, tmp_path):
    path = put(tmp_path / "list.csv", "digital_music, software,  video_games\n")
    names = readers.read_category_list(spark, path)
    assert names == ["digital_music", "software", "video_games"]
    df = spark.createDataFrame([("software",), ("books",)], "type string")
    assert readers.category_allowlist(df, names).count() == 1
    assert readers.category_allowlist(df, "all").count() == 2
    with pytest.raises(KeyError, match="boks"):
        readers.category_allowlist(df, ["boks"])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a\nb",), (None,), ("c",)], "t string")
    writers.corpus_text_export(df, "t", str(tmp_path / "text"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["a b", "c"]
    metrics = spark.createDataFrame([(1.0,)], "f1 double")
    for _ in range(2):
        writers.write_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    log = spark.createDataFrame([("r", "loss", 0.5, 1)], "run string, tag string, value double, step int")
    for _ in range(2):
        writers.append_metric_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_vocab_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("abc abc bcd",)], "t string")
    vocab, merges = bpe.bpe_train(df, "t", 12)
    writers.vocab_save(vocab, merges, str(tmp_path / "v"))
    back = readers.vocab_load(spark, str(tmp_path / "v"))
    assert [sorted(map(tuple, a.collect())) for a in back] == [sorted(map(tuple, a.collect())) for a in (vocab, merges)]


@pytest.mark.parametrize("joined", [True, False])
def test_vocab_from_json(spark, tmp_path, joined):
    rules = [["a", "b"], ["ab", "c"]]
    model = {"vocab": {"<PAD>": 0, "a": 1, "b": 2, "c": 3, "ab": 4, "abc": 5},
             "merges": [" ".join(r) for r in rules] if joined else rules}
    path = put(tmp_path / "t.json", json.dumps({"version": "1.0", "model": model}, indent=2))
    vocab, merges = readers.vocab_load(spark, path)
    assert {r.token: r.id for r in vocab.collect()} == model["vocab"]
    assert [(r["rank"], r.left, r.right) for r in merges.orderBy("rank").collect()] == [(0, "a", "b"), (1, "ab", "c")]
    df = spark.createDataFrame([("abc cab",)], "t string")
    assert bpe.encode_text(df, "t", vocab, merges).first().ids == [5, 3, 4]


def test_streamed_confusion_equals_batch(spark, tmp_path):
    for part in range(3):
        spark.range(50).select(
            (F.col("id") % 3).cast("int").alias("y_true"), ((F.col("id") * (part + 1)) % 3).cast("int").alias("y_pred")
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("y_true int, y_pred int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    got = {(r.y_true, r.y_pred): r.n for r in running_confusion_stream(stream, 4).collect()}
    want = {}
    for r in spark.read.parquet(str(tmp_path / "p")).collect():
        want[r.y_true, r.y_pred] = want.get((r.y_true, r.y_pred), 0) + 1
    assert got == {(i, j): want.get((i, j), 0) for i in range(4) for j in range(4)}


class NamedFolder:
    """A session as far as the scratch folder is concerned."""

    def __init__(self, folder, master="yarn"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_scratch_folder_follows_the_session():
    assert scratch_path(NamedFolder("hdfs://shared/dir/"), "x").startswith("hdfs://shared/dir/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(NamedFolder(None), "x")


def test_pin_small_leaves_large_results_alone(spark):
    df = spark.range(20)
    large = pin_small(df, 10)
    assert large.inputFiles() and sorted(r.id for r in large.collect()) == list(range(20))
    assert sorted(r.id for r in pin_small(df, 20).collect()) == list(range(20))


def test_spread_small(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread_small(spark.range(1000, numPartitions=1), "id").rdd.getNumPartitions() == cores
    assert spread_small(spark.range(45, numPartitions=1), "id").rdd.getNumPartitions() == 2
    many = spark.range(100, numPartitions=5 * cores)
    assert spread_small(many, "id") is many


def test_json_arrays_are_cut_anywhere(spark, tmp_path):
    import json

    from textscore.sources.arrays import read_json_arrays

    odd = ['plain', '"', '\\', '\\"', '}', '{', '"}, {"', '\\\\"}', "}{" * 5, "é}漢", "", None, '[{"a": 1}]', "\n}\n"]
    rows = [{"t": odd[i % len(odd)], "n": {"x": i, "deep": {"y": odd[(i * 5) % len(odd)]}}, "i": i} for i in range(40)]
    schema = spark.createDataFrame([], "t string, n struct<x:int,deep:struct<y:string>>, i int").schema
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(rows), encoding="utf-8")
    (folder / "b.json").write_text(json.dumps(rows[:7], indent=3, ensure_ascii=False), encoding="utf-8")
    (folder / "c.json").write_text("[]")
    (folder / "d.json").write_text(json.dumps(rows[3]))
    (folder / "e.json").write_text("")
    want = sorted(map(repr, spark.read.schema(schema).option("multiLine", True).json(str(folder)).where("i is not null").collect()))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for size in (1 << 20, 301, 97, 31):
            spark.conf.set(names[0], str(size))
            spark.conf.set(names[1], "1")
            found = read_json_arrays(spark, [str(folder)], schema)
            got = found.collect()
            assert sorted(repr(r.__class__(**{k: r[k] for k in ("t", "n", "i")})) for r in got) == want, size
            order = [r["i"] for r in sorted((r for r in got if r["_file"].endswith("a.json")), key=lambda r: (r["_block"], r["_line"]))]
            assert order == list(range(40))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_quoted_tables_are_cut_anywhere(spark, tmp_path, ends):
    from textscore.sources.quoted import read_quoted

    odd = ["plain", '"two\nlines"', '"a ""quoted"" word"', '""', "", 'an inch: 5" wide', '"tab\there"', '"\n\n"', '"caf\xe9\n""\n""x"',
           '"ends in a quote"""', '"""starts"', " blank ", '"x\n\ty\n"', "'single'", '"loose" end', '"\r\n"']
    rows = [f"{i}\t{odd[i % len(odd)]}\t{odd[(i * 7 + 3) % len(odd)]}" for i in range(60)]
    folder = tmp_path / "tables"
    folder.mkdir()

    def put_rows(name, rows, end=ends):
        (folder / name).write_bytes(ends.join(rows).encode("latin-1") + (ends if end else "").encode())

    put_rows("a.tsv", ["i\tt\tu", *rows])
    put_rows("b.tsv", ["", 'i\t"t\nu"\tu', "", *rows[:9], "", "7\tx", *rows[3:5]], end="")
    put_rows("c.tsv", ["i\tt\tu"])
    put_rows("d.tsv", [])
    schema = spark.createDataFrame([], "i int, t string, u string").schema
    want = sorted(map(repr, spark.read.schema(schema).csv(
        str(folder), sep="\t", header=True, encoding="ISO-8859-1", multiLine=True, quote='"', escape='"').collect()))
    assert len(want) == 60 + 12
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for size in (1 << 20, 211, 53, 17):
            spark.conf.set(names[0], str(size))
            spark.conf.set(names[1], "1")
            got = read_quoted(spark, str(folder), schema).collect()
            assert sorted(repr(r.__class__(**{k: r[k] for k in ("i", "t", "u")})) for r in got) == want, size
            order = [r["i"] for r in sorted((r for r in got if r["_file"].endswith("a.tsv")), key=lambda r: (r["_block"], r["_line"]))]
            assert order == list(range(60))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_open_cells_at_every_byte():
    from textscore.sources.quoted import open_after

    for line, plain, quoted in [(b"", False, True), (b"a\tb", False, True), (b'"a', True, False), (b'a"', False, False), (b'a\t"b', True, False),
                                (b'a\t""', False, True), (b'"a"\t"b', True, True), (b'"a"x"\ty', False, False), (b'x""y', False, True),
                                (b'"', True, False), (b'""', False, True), (b'"""', True, False), (b'\t\t"', True, False), (b'"\t"z', False, True)]:
        assert (open_after(line, False), open_after(line, True)) == (plain, quoted), line


BATCH = "run string, batch_id bigint, y_true array<int>, y_pred array<int>, loss double"


def expected_running(batches, k, size):
    out, sums = {}, {}
    for run, b, y, p, loss in sorted(batches, key=lambda r: r[:2]):
        hits, rows, total = sums.setdefault(run, ([0] * k, [0] * k, [0.0]))
        for t, g in zip(y, p):
            rows[t] += 1
            hits[t] += t == g
        total[0] += loss
        inverse = sum((sum(rows) + n) / (2 * h) for h, n in zip(hits, rows) if h)
        seen = (b + 1) * size
        out[run, b] = (sum(hits), total[0], 100 * sum(hits) / seen, total[0] / seen, k / inverse if inverse else float("inf"))
    return out


def test_streamed_running_metrics_in_any_order(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(running, "STATE_BLOCK", 8)
    rng = random.Random(5)
    batches = [(run, b, [rng.randrange(3) for _ in range(4)], [rng.randrange(3) for _ in range(4)], rng.random()) for run in "ab" for b in range(20)]
    path, folder = str(tmp_path / "in"), str(tmp_path / "kept")

    def arrive(rows):
        spark.createDataFrame(rows, BATCH).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(path)
        rows = running.running_metrics_stream(stream, 3, 4, folder).collect()
        return {(r.run, r.batch_id): (r.correct, r.loss, r.accuracy, r.mean_loss, r.f1) for r in rows}

    mixed = rng.sample(batches, len(batches))
    arrive(mixed[:13])
    arrive(mixed[5:20] + mixed[:3])
    first = run()
    assert first.keys() == {r[:2] for r in mixed[:20]}
    assert first == {p: pytest.approx(v) for p, v in expected_running(mixed[:20], 3, 4).items()}
    arrive(mixed[15:])
    arrive(mixed)
    last = run()  # a new start, which goes on from the folder
    assert last == {p: pytest.approx(v) for p, v in expected_running(batches, 3, 4).items()}
    assert run() == last


def test_running_metrics_of_no_batches_and_wrong_ones(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    stream = spark.readStream.schema(BATCH).parquet(str(path))
    assert running.running_metrics_stream(stream, 3).collect() == []
    for row in [("a", 0, [3], [0], 1.0), ("a", 0, [0, 1], [0], 1.0), ("a", 0, [None], [0], 1.0), (None, 0, [1], [1], 1.0), ("a", 0, None, [1], 1.0)]:
        with pytest.raises(Exception, match="no class|length|null"):
            running.batch_sums(spark.createDataFrame([row], BATCH), 3).collect()
    rows = running.batch_sums(spark.createDataFrame([("a", 0, [], [], None)], BATCH), 3).collect()
    assert [(r.loss, r.rows_0, r.hits_2) for r in rows] == [(0.0, 0, 0)]
    assert running.running_rows(running.batch_sums(spark.createDataFrame([("a", 0, [1], [0], 1.0)], BATCH), 3), 3, 4).first().f1 == float("inf")


def test_bits_are_set_once():
    assert running.new_bits(0b101, [0, 1, 1, 3, 2]) == (0b1111, [1, 3])
