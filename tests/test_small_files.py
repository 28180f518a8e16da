import collections
import random
import re

import pytest
import zstandard

from glyphgrove.functions.paths import canonical_path
from glyphgrove.operators import small_files as sf
from tests.skew import large

ROOT = "/data/root"


@pytest.mark.parametrize(
    "raw",
    ["corpus/a/x.mml", " ./corpus//a/x.mml\t", "/data/root/corpus/b/../a/x.mml", "file:///data/root/corpus/a/x.mml", "corpus\\a\\x.mml", "corpus/a/%78.mml", "FILE://localhost/data/root/corpus/a/x.mml", "corpus/a/x%2Emml"],
)
def test_spellings_of_one_path(raw):
    assert canonical_path(raw, ROOT) == "/data/root/corpus/a/x.mml"


def test_paths_that_differ():
    assert canonical_path("corpus/A/x.mml", ROOT) != canonical_path("corpus/a/x.mml", ROOT)
    assert canonical_path("a/\u00c9.mml", ROOT) == canonical_path("a/E\u0301.mml", ROOT)
    assert canonical_path("a/%FF.mml", ROOT) == "/data/root/a/%FF.mml"
    assert canonical_path(None, ROOT) is None
    assert canonical_path("../../../..", ROOT) == "/"


LISTING = "doc_id bigint, path string, n_bytes bigint, folder string"


def brute(rows, least, root=ROOT):
    files = collections.defaultdict(list)
    for i, p, n, _ in rows:
        c = canonical_path(p, root)
        if c and c.startswith(root + "/"):
            files[c].append((i, n))
    small = collections.defaultdict(list)
    for c, v in files.items():
        folder, name = c.rsplit("/", 1)
        sizes = [n for _, n in v if n is not None]
        if re.search(r"\.(mml|mathml|xhtml|html|tex)$", name, re.I) and name[0] not in "._" and sizes and 0 < max(sizes) < 8192:
            small[folder].append(min(i for i, _ in v))
    return sorted(i for v in small.values() if len(v) >= least for i in v)


def test_plan_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        p = f"corpus/{rnd.choice('abc')}/{rnd.randint(1, 90)}{rnd.choice(['.mml', '.TEX', '.png', '', '.html'])}"
        p = rnd.choice([p, "./" + p, p.replace("/", "\\"), f" {ROOT}/{p}", p.replace("corpus", "corpus/z/..")])
        rows.append((i, p, rnd.choice([None, 0, 5, 8191, 8192]), "clash"))
    rows += [(900 + i, None, 5, None) for i in range(30)] + [(950, "", 5, None), (951, "_x.mml", 5, None)]
    plan = sf.plan_packs(sf.inventory(spark.createDataFrame(rows, LISTING), ROOT), least_files=20)
    found = plan.collect()
    assert sorted(r["file_id"] for r in found) == brute(rows, 20)
    assert len({r["file"] for r in found}) == len(found)


def test_whole_table(spark, data):
    t = spark.read.parquet(f"{data}/doc_list.parquet").select("doc_id", "path", "n_bytes").collect()
    from glyphgrove.plans.hygiene import CORPUS_ROOT, p1_found

    got = sorted(r["doc_id"] for r in p1_found(spark, data).collect())
    assert got == brute([(*r, None) for r in t], 20, CORPUS_ROOT)


def test_empty_listing(spark):
    assert sf.plan_packs(sf.inventory(spark.createDataFrame([], LISTING), ROOT)).count() == 0


def test_big_folder_is_spread(spark):
    rows = [(i, f"f/{i}.mml", 1000, None) for i in range(2000)]
    plan = sf.plan_packs(sf.inventory(spark.createDataFrame(rows, LISTING), ROOT), target_bytes=50_000, packs_per_bucket=4).collect()
    packs = collections.Counter(r["pack"] for r in plan)
    assert len(plan) == 2000 and len(packs) >= 40 and max(packs.values()) <= 51
    places = {(r["pack"], r["planned_offset"]) for r in plan}
    assert len(places) == 2000


def make(tmp_path, files):
    (tmp_path / "in").mkdir()
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    return [(i, str(tmp_path / "in" / n), len(c), None) for i, (n, c) in enumerate(files.items())]


def pack(spark, tmp_path, rows, **options):
    plan = sf.plan_packs(sf.inventory(spark.createDataFrame(rows, LISTING), ""), least_files=1)
    target = str(tmp_path / "out")
    manifest = spark.createDataFrame(sf.write_packs(plan, target, **options).collect(), sf.MANIFEST)
    checked = sf.verify_packs(manifest, target).collect()
    packs = [p.read_bytes() for p in sorted((tmp_path / "out").rglob("pack-*"))]
    return {r["file"].rsplit("/", 1)[1]: r for r in manifest.collect()}, checked, packs


def test_lines_are_joined_at_boundaries(spark, tmp_path):
    rows = make(tmp_path, {"a.mml": b"1\n2\n", "b.mml": b"3", "c.mml": b"\xef\xbb\xbf4\n"})
    manifest, checked, packs = pack(spark, tmp_path, rows)
    assert packs == [b"1\n2\n3\n4\n"]
    assert [(r["length_ok"], r["gapless"], r["n_bad"], r["n_files"]) for r in checked] == [(True, True, 0, 3)]
    assert manifest["b.mml"]["offset"] == 4 and manifest["b.mml"]["length"] == 2


def test_headers_are_kept_once(spark, tmp_path):
    rows = make(tmp_path, {"a.mml": b"h\n1\n", "b.mml": b"h\r\n2\n", "c.mml": b"other\n3\n", "d.mml": b"h\n4"})
    manifest, checked, packs = pack(spark, tmp_path, rows, header_lines=1)
    assert packs == [b"h\n1\n2\n4\n"] and manifest["c.mml"]["status"] == "other header"
    assert checked[0]["n_bad"] == 0 and checked[0]["length_ok"]


def test_frames_are_appended_whole(spark, tmp_path):
    c = zstandard.ZstdCompressor(write_checksum=True)
    skippable = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
    big = random.Random(2).randbytes(5000)
    files = {"a.mml": c.compress(b"one "), "b.mml": c.compress(b"two ")[:-1], "c.mml": skippable + c.compress(big), "d.mml": c.compress(b"") + c.compress(b"x" * 7000)}
    manifest, checked, packs = pack(spark, tmp_path, make(tmp_path, files), kind="zstd")
    assert manifest["b.mml"]["status"] == "not whole frames" and manifest["b.mml"]["length"] == 0
    whole = zstandard.ZstdDecompressor().stream_reader(packs[0], read_across_frames=True).read()
    assert whole == b"one " + big + b"x" * 7000
    assert checked[0]["n_bad"] == 0 and checked[0]["gapless"]


def test_other_length_is_left_alone(spark, tmp_path):
    rows = make(tmp_path, {"a.mml": b"1\n", "b.mml": b"22\n"})
    rows[1] = (1, rows[1][1], 99, None)
    manifest, _, packs = pack(spark, tmp_path, rows)
    assert manifest["b.mml"]["status"] == "other length" and packs == [b"1\n"]


def test_damage_is_noticed(spark, tmp_path):
    rows = make(tmp_path, {"a.mml": b"1\n", "b.mml": b"2\n"})
    plan = sf.plan_packs(sf.inventory(spark.createDataFrame(rows, LISTING), ""), least_files=1)
    manifest = spark.createDataFrame(sf.write_packs(plan, str(tmp_path / "out")).collect(), sf.MANIFEST)
    p = next((tmp_path / "out").rglob("pack-*"))
    p.write_bytes(p.read_bytes()[:-2] + b"X\nmore")
    r = sf.verify_packs(manifest, str(tmp_path / "out")).first()
    assert r["n_bad"] == 1 and not r["length_ok"]


def test_hot_folder_is_split(spark):
    rows = [(i, f"hot/{i}.mml", 1000, None) for i in range(3000)] + [(3000 + i, f"f{i % 200}/{i}.mml", 10, None) for i in range(6000)]
    want = brute(rows, 20)
    with large(spark) as split:
        plan = sf.plan_packs(sf.inventory(spark.createDataFrame(rows, LISTING), ROOT))
        assert sorted(r["file_id"] for r in plan.collect()) == want
        assert split() >= 1


def test_buckets_follow_the_number_of_files(spark):
    rows = [(i, f"f/{i}.mml", 1, None) for i in range(900)]
    plan = sf.plan_packs(sf.inventory(spark.createDataFrame(rows, LISTING), ROOT), files_per_bucket=100).collect()
    packs = collections.Counter(r["pack"] for r in plan)
    assert len(packs) == 9 and max(packs.values()) < 200 and sum(packs.values()) == 900


def test_member_that_is_gone(spark, tmp_path):
    rows = make(tmp_path, {"a.mml": b"1\n", "b.mml": b"2\n"})
    (tmp_path / "in" / "a.mml").unlink()
    manifest, checked, packs = pack(spark, tmp_path, rows)
    assert manifest["a.mml"]["status"] == "not there" and packs == [b"2\n"] and checked[0]["n_files"] == 1


def test_members_are_written_packed_and_verified(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"d{i % 2}", f"{i}.html", None if i == 5 else "äx\n" * (i % 3), "clash") for i in range(60)], "doc_id bigint, f string, n string, text string, path string")
    listing = sf.write_members(docs, str(tmp_path / "in"), folder="f", name="n", content="text")
    rows = [(i, r["path"], r["n_bytes"], None) for i, r in enumerate(listing.collect())]
    assert len(rows) == 59 and all((tmp_path / "in" / p.split("/in/")[1]).stat().st_size == n for _, p, n, _ in rows)
    manifest, checked, packs = pack(spark, tmp_path, rows)
    assert sum(r["n_files"] for r in checked) == len(manifest) == sum(n > 0 for *_, n, _ in rows)
    assert b"".join(packs).decode() == "äx\n" * sum(n // 4 for *_, n, _ in rows)
