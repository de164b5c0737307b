import os
import random
from datetime import datetime, timedelta

import pytest

from keydrift.operators.diff import missing_keys
from keydrift.operators.users import provision
from keydrift.sources import folders
from keydrift.sources.folders import FolderStore, changed_pairs, refresh, stored_pairs
from keydrift.sources.schemas import USERS
from keydrift.sources.tables import document_pairs
from keydrift.streaming.logins import login_log_writer, provisioned

LOGIN = "id string, email string, login_at timestamp"


def shown(frame):
    return sorted(map(str, frame.collect()))


def random_logins(seed, n):
    """Logins of which a third have one email or one id, with equal, missing and scattered times."""
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        key = "hot" if draw.random() < 0.3 else draw.choice([f"u{draw.randrange(60)}", None, "held"])
        email = "shared" if draw.random() < 0.3 else draw.choice([f"m{draw.randrange(40)}", None, ""])
        at = None if draw.random() < 0.03 else datetime(2024, 1, 1) + timedelta(seconds=draw.randrange(n // 3))
        rows.append((key, email, at))
    return rows


def by_replay(users, rows):
    """Admitted and refused (id, email) by taking ids in the order of their first login."""
    first = {}
    none_first = lambda x: (x is not None, x)
    place = lambda r: (none_first(r[2]), none_first(r[1]))
    for row in rows:
        if row[0] is not None and (row[0] not in first or place(row) < place(first[row[0]])):
            first[row[0]] = row
    held, kept, refused = {u[1] for u in users}, [], []
    for key, email, _ in sorted(first.values(), key=lambda r: (none_first(r[2]), r[0])):
        if key in {u[0] for u in users}:
            continue
        (refused if (email or "") in held else kept).append((key, email or ""))
        held.add(email or "")
    return sorted(kept), sorted(refused)


@pytest.mark.parametrize("seed", [1, 2])
def test_feeds_in_any_order_give_one_profile_per_email(spark, tmp_path, seed):
    users = [(k, e, "support", "system", None, None, None) for k, e in (("held", "m1"), ("other", "m2"))]
    stored = spark.createDataFrame(users, USERS)
    rows, log = random_logins(seed, 400), str(tmp_path / "log")

    def take(part, feed):
        spark.createDataFrame(part, LOGIN).coalesce(2).write.mode("append").parquet(str(tmp_path / feed))
        stream = spark.readStream.schema(LOGIN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / feed))
        writer = login_log_writer(stream, log, feed, str(tmp_path / f"check-{feed}"))
        writer.trigger(availableNow=True).start().awaitTermination()

    for k, feed in enumerate(["one", "two", "one"]):
        take(rows[k::3], feed)
        kept, refused = provisioned(spark, stored, log)
        so_far = [r for j in range(k + 1) for r in rows[j::3]]
        new = kept.where("id NOT IN ('held', 'other')")
        assert (sorted((r.id, r.email) for r in new.collect()), sorted((r.id, r.email) for r in refused.collect())) == by_replay(users, so_far)
    for mine, whole in zip(provisioned(spark, stored, log), provision(stored, spark.createDataFrame(rows, LOGIN)), strict=True):
        assert shown(mine) == shown(whole)
    # The state says one login per id and batch, however many a batch has.
    told = spark.read.parquet(log)
    assert told.groupBy("feed", "batch_id", "id").count().where("count > 1").isEmpty()


def put(folder, name, text, at):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode() if isinstance(text, str) else text)
    os.utime(folder / name, (at, at))


@pytest.mark.parametrize("whole", [0.0, 0.5, 1.0])
def test_refreshes_read_changed_files_only(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(folders, "WHOLE", whole)
    monkeypatch.setattr(folders, "FILES_PER_SCAN", 2)
    main, dev = tmp_path / "main", tmp_path / "dev"
    for k in range(6):
        put(main, f"p{k}.json", f'{{"k":{k}}}', 1000)
        put(dev, f"p{k}.json", f'{{"k":{k},"new{k}":1}}', 1000)
    put(main, "a[1]{x}*+%20, b.json", "{}", 1000)
    put(dev, "a[1]{x}*+%20, b.json", '{"é":"ü"}', 1000)
    put(dev, "empty.json", "", 1000)
    put(dev, "odd.json", b'{"\xff":1}', 1000)
    store = FolderStore(str(tmp_path / "store"), str(main), str(dev))

    def read_now():
        return refresh(spark, store), {r.path.rsplit("/", 2)[1] + "/" + r.path.rsplit("/", 1)[1] for r in texts(store.version(spark))}

    def texts(version):
        return spark.read.parquet(f"{store.path}/texts/version={version}").collect()

    def check():
        whole = document_pairs(spark, str(main), str(dev))
        assert shown(stored_pairs(spark, store)) == shown(whole)
        assert shown(missing_keys(stored_pairs(spark, store))) == shown(missing_keys(whole))
        changed, gone = changed_pairs(spark, store)
        return sorted(r.pair_id for r in changed.collect()), sorted(r.pair_id for r in gone.collect())

    version, read = read_now()
    assert version == 1 and len(read) == 15 and "dev/empty.json" not in read  # no scan gives empty files
    changed, gone = check()
    assert len(changed) == 8 and gone == []
    # One file changed, one touched, one of the same length and an older time, one new, two removed.
    put(main, "p0.json", '{"k":0,"z":1}', 2000)
    put(main, "p1.json", '{"k":1}', 2000)
    put(dev, "a[1]{x}*+%20, b.json", '{"ö":"ü"}', 500)
    put(dev, "new.json", "{}", 500)
    (main / "p2.json").unlink()
    (dev / "odd.json").unlink()
    version, read = read_now()
    assert version == 2 and read == {"main/p0.json", "main/p1.json", "dev/a[1]{x}*+%20, b.json", "dev/new.json"}
    assert check() == (["a[1]{x}*+%20, b", "new", "p0", "p2"], ["odd"])
    # A second extension renames a pair.
    put(main, "p3.txt", "{}", 3000)
    assert read_now() == (3, {"main/p3.txt"})
    assert check() == (["p3.json", "p3.txt"], ["p3"])
    assert read_now() == (4, set())
    assert check() == ([], [])


def test_a_refresh_cut_short_is_run_again(spark, tmp_path):
    main, dev = tmp_path / "main", tmp_path / "dev"
    put(main, "a.json", "{}", 1000)
    put(dev, "a.json", '{"x":1}', 1000)
    store = FolderStore(str(tmp_path / "store"), str(main), str(dev))
    half = spark.createDataFrame([("target", "gone", "{", "no")], "side string, path string, text string, digest string")
    half.write.parquet(f"{store.path}/texts/version=1")
    assert store.version(spark) == 0 and refresh(spark, store) == 1
    assert shown(stored_pairs(spark, store)) == shown(document_pairs(spark, str(main), str(dev)))
