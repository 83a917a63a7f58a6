"""The operation log, snapshots, recovery, vector files and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from skeinlake.operators.schema import Attr, Config, Schema
from skeinlake.operators.service import Service
from skeinlake.sources import store as S
from skeinlake.sources import vecs
from skeinlake.sources.store import Store

SCHEMA = Schema((Attr("tag", "tag"), Attr("flag", "bool")))


def test_recovery_of_all_write_paths(spark, tmp_path):
    config = Config(2, schema=SCHEMA)
    table = Store(spark, f"file://{tmp_path}/t", config)
    assert table.append([{"op": "insert", "vec": [float(i), 0.0], "attrs": ["pre", True]} for i in range(6)]) == list(range(6))
    assert table.append([{"op": "update", "id": 1, "vec": [9.0, 9.0]}, {"op": "set_meta", "id": 2, "attrs": ["changed", None]}, {"op": "delete", "id": 3}, {"op": "delete", "id": 77}]) == [True, True, True, False]
    table.checkpoint()
    table.append([{"op": "insert", "vec": [0.0, 1.0], "attrs": ["post", False]}, {"op": "delete", "id": 0}])
    again = Store(spark, f"file://{tmp_path}/t", config)
    rows = {r["id"]: r for r in again.current().collect()}
    assert sorted(rows) == [1, 2, 4, 5, 6] and again.next_id == 7
    assert list(rows[1]["vec"]) == [9.0, 9.0] and rows[1]["tag"] == "pre" and rows[2]["tag"] == "changed" and rows[2]["flag"] is None
    assert {r["value"]: r["n"] for r in S.attr_counts(again.current(), "tag").collect()} == {"pre": 3, "changed": 1, "post": 1}
    assert again.tombstones() == 3
    again.compact()
    assert again.tombstones() == 0 and again.current().count() == 5 and again.contains(6) and not again.contains(0)
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/t", Config(3, schema=SCHEMA))
    with pytest.raises(ValueError):
        again.append([{"op": "insert", "vec": [1.0], "attrs": None}])


def test_fold_equals_a_dictionary(spark):
    rng, state, log, dead = random.Random(4), {}, [], set()
    for lsn in range(1, 301):
        op, i = rng.choice(["insert", "update", "set_meta", "delete"]), rng.randrange(60)
        if op == "insert":
            i = len(state) + len(dead)
            state[i] = [float(lsn), f"m{lsn}"]
        elif i not in state:
            continue
        elif op == "update":
            state[i][0] = float(lsn)
        elif op == "set_meta":
            state[i][1] = None if lsn % 2 else f"m{lsn}"
        else:
            del state[i]
            dead.add(i)
        vec, meta = ([float(lsn)] if op in ("insert", "update") else None), (f"m{lsn}" if op == "insert" or (op == "set_meta" and lsn % 2 == 0) else None)
        log.append((lsn, op, i, vec, meta, None, vec is not None, op in ("insert", "set_meta")))
    rng.shuffle(log)
    rows = spark.createDataFrame(log, "lsn bigint, op string, id bigint, vec array<float>, tag string, payload binary, has_vec boolean, has_meta boolean")
    assert {r["id"]: [r["vec"][0], r["tag"]] for r in S.fold(rows, ["tag"]).collect()} == state


def test_vector_files(spark, tmp_path):
    data = [[1.0, 2.5], [3.0, -4.0]]
    (tmp_path / "x.fvecs").write_bytes(vecs.encode(data))
    (tmp_path / "x.ivecs").write_bytes(vecs.encode([[7, 8]], "<i4"))
    assert [list(r["vec"]) for r in vecs.read_fvecs(spark, f"file://{tmp_path}/x.fvecs", 2).orderBy("id").collect()] == data
    found = vecs.read_fvecs(spark, f"file://{tmp_path}/x.fvecs", limit=1).collect()  # the dimension is in the file
    assert [(r["id"], list(r["vec"])) for r in found] == [(0, data[0])]
    with pytest.raises(Exception, match="dimension"):
        (tmp_path / "y.fvecs").write_bytes(vecs.encode([[1.0, 2.0], [3.0]]) + b"1234")
        vecs.read_fvecs(spark, f"file://{tmp_path}/y.fvecs").collect()
    assert list(vecs.read_ivecs(spark, f"file://{tmp_path}/x.ivecs", 2).first()["vec"]) == [7, 8]
    assert vecs.crc32c(b"123456789") == 0xE3069283


def test_service(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/s", dim=3)
    kettle = s.insert([1.0, 0.0, 0.0], "tin kettle", "kitchen", b"k")
    lamp = s.insert([0.0, 4.0, 0.0], "brass lamp with tin base", "light")
    assert [h["id"] for h in s.search_vector([0.0, 3.0, 0.0], 2)] == [lamp, kettle] and s.search_vector([0.0, 3.0, 0.0], 2, "kitchen")[0]["id"] == kettle
    assert [h["description"] for h in s.search_text("brass", 3)] == ["brass lamp with tin base"] and s.search_text("brass", 3, "kitchen") == []
    assert [h["id"] for h in s.search_hybrid([1.0, 0.0, 0.0], "tin", 2)] == [kettle, lamp]
    assert [h["id"] for h in s.run("brass --vec 0,4,0 --k 1")] == [lamp] and [h["id"] for h in s.run("tin --cat light")] == [lamp]
    assert bytes(s.get_metadata(kettle)["payload"]) == b"k" and s.remove(kettle) and not s.remove(kettle) and s.get_metadata(kettle) is None
    assert s.search_text("kettle", 3) == [] and s.stats() == {"size": 1, "deleted": 1, "dim": 3}


def numbered(spark, tmp_path, n=3, every=None):
    table = Store(spark, f"file://{tmp_path}/n", Config(1, schema=SCHEMA), every)
    for i in range(n):
        table.append([{"op": "insert", "vec": [float(i)], "attrs": [f"t{i}", None]}])
    return table


def again(table):
    return Store(table.spark, table.path, table.config)


def test_bulk_inserts_reserved_ids_and_clear(spark, tmp_path):
    table = numbered(spark, tmp_path, 1)
    rows = spark.range(50).repartition(7).select(F.array(F.col("id").cast("float")).alias("vec"), F.lit("bulk").alias("tag"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("binary").alias("payload"))
    table.insert_rows(rows)
    table.verify()
    assert sorted(r["id"] for r in table.current().collect()) == list(range(51)) and table.next_id == again(table).next_id == 51
    held = table.reserve_ids(2)
    assert table.append([{"op": "insert", "vec": [0.5]}, {"op": "insert", "vec": [0.6], "id": held[1]}]) == [53, 52]
    for bad in (held[1], 7, 99):
        with pytest.raises(ValueError):
            table.append([{"op": "insert", "vec": [0.6], "id": bad}])
    facts = table.describe()
    assert facts["rows"] == 53 and facts["attrs"] == {"tag": "tag", "flag": "bool"} and facts["attr_count"] == 2 and facts["dim"] == 1 and facts["durable_lsn"] == table.lsn
    row = spark.range(1).select(*[a.value(v).alias(a.name) for a, v in zip(SCHEMA.attrs, ["x", None], strict=True)])
    assert [f.dataType for f in row.schema] == [f.dataType for f in SCHEMA.struct()]
    table.clear()
    assert table.current().count() == 0 and again(table).insert([1.0]) == 54


def test_checkpoints_cut_the_log_and_come_by_themselves(spark, tmp_path):
    table = numbered(spark, tmp_path, 5, every=3)
    assert table.manifest["lsn"] == 3 and len(table.commits) == 2 and len(table._names("log")) == 2 == len(table._names("claims"))
    assert again(table).current().count() == 5
    for _ in range(4):
        table.checkpoint()
    assert table._names("log") == [] and len(table._names("manifests")) == 2 and len(table._names("snapshots")) <= 2
    assert sorted(r["tag"] for r in again(table).current().collect()) == ["t0", "t1", "t2", "t3", "t4"]


def test_a_commit_cut_short_is_dropped_and_damage_before_others_is_not(spark, tmp_path):
    table = numbered(spark, tmp_path)
    table._remove("log/00000000000000000003/_SUCCESS")
    short = again(table)
    assert sorted(r["id"] for r in short.current().collect()) == [0, 1] and short.insert([9.0]) == 2 and again(short).current().count() == 3
    short._remove("log/00000000000000000002/_SUCCESS")
    with pytest.raises(RuntimeError):
        again(short)


def test_missing_and_altered_commits_raise(spark, tmp_path):
    table = numbered(spark, tmp_path)
    other = again(table)
    rows = spark.read.parquet(f"{table.path}/log/00000000000000000002").withColumn("lsn", F.lit(7).cast("long"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    rows.write.mode("overwrite").parquet(f"{table.path}/log/00000000000000000002")
    with pytest.raises(RuntimeError):
        other.verify()
    table._remove("claims/00000000000000000002.json")
    with pytest.raises(RuntimeError):
        again(table)


def test_a_second_writer_is_refused(spark, tmp_path):
    table = numbered(spark, tmp_path, 1)
    late = again(table)
    table.insert([5.0])
    with pytest.raises(RuntimeError):
        late.insert([6.0])
    assert sorted(r["vec"][0] for r in again(table).current().collect()) == [0.0, 5.0]


def test_an_unreadable_manifest_gives_way_to_the_one_before(spark, tmp_path):
    table = numbered(spark, tmp_path)
    table.checkpoint()
    number = table.manifest["number"] + 1
    out = table._fs.create(table._to(f"{table.path}/manifests/{number:020d}.json"), False)
    out.write(b"{\"dim\"")
    out.close()
    assert again(table).manifest["number"] == number - 1 and again(table).current().count() == 3
