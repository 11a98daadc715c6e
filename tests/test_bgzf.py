"""Blocked gzip: ranges, push-down and indexes."""

import gzip
import random
import struct
from pathlib import Path

import pytest

from varicube.sources import bgzf, tables, vcf

LINES = [(f"chr{1 + i // 700}", f"chr{1 + i // 700}\t{i}\t{i + 7}\t" + random.Random(i).choice(["x", "y" * 50, "z" * 3000])) for i in range(3000)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocked") / "lines")
    frame = spark.createDataFrame([(c, v, i) for i, (c, v) in enumerate(LINES)], "contig string, value string, place int").repartition(5)
    bgzf.write_lines(frame, path, "place", header=["#a header", "#chrom\tstart\tend\tname"])
    return path


def whole(tmp_path, texts, end=True):
    path = tmp_path / "one.bed.gz"
    path.write_bytes(b"".join(bgzf.member(t) for t in texts) + (bgzf.END if end else b""))
    return str(path)


@pytest.mark.parametrize("split_bytes", [1 << 24, 40_000, 1_000])
def test_every_line_once_for_any_split(spark, folder, split_bytes):
    rows = bgzf.read_lines(spark, folder, split_bytes=split_bytes)
    found = [tuple(r) for r in rows.collect()]
    assert sorted(r for r in found if r[0] is not None) == sorted(LINES)
    files = len(list(Path(folder).glob("*.gz")))
    assert len([r for r in found if r[0] is None]) == 2 * files
    if split_bytes == 1_000:
        assert rows.rdd.getNumPartitions() > 2 * files


@pytest.mark.parametrize("texts", [
    [b"a\t1\nb\t2\n", b"c\t3\nd\t4\n"],  # a member ends with its line
    [b"a\t1\nb", b"\t", b"2\nc\t3"],  # a line over three members, no line end at the end
    [b"a\t1", b"", b"\n", b"\n\nb\t2\n"], [b"x" * 60_000, b"y" * 60_000, b"\nz\t1\n"], [b""], [b"\n"],
])
def test_lines_across_members(spark, tmp_path, texts):
    path = whole(tmp_path, texts)
    expected = b"".join(texts).decode().split("\n")
    expected = sorted(expected[:-1] if expected[-1] == "" else expected)
    for split in (1 << 20, 50, 20, 3):
        assert sorted(r["value"] for r in bgzf.read_lines(spark, path, split_bytes=split).collect()) == expected
    assert gzip.decompress(Path(path).read_bytes()) == b"".join(texts)  # plain gzip reads it too


def test_contig_reads_only_its_members(spark, folder, monkeypatch):
    reader = bgzf.ContigReader(folder, 1 << 24)
    assert list(reader.pushFilters([bgzf.EqualTo(("contig",), "chr3")])) == []
    ranges = reader.partitions()
    everything = sum(size for _, size in bgzf.files_of(folder))
    assert 0 < sum(r.end - r.begin for r in ranges) < everything * 0.6
    lines = bgzf.read_lines(spark, folder, ["chr3"])
    assert sorted(r["value"] for r in lines.collect()) == sorted(v for c, v in LINES if c == "chr3")
    assert "chr3" not in lines._jdf.queryExecution().executedPlan().toString()  # nothing but the null test is left to Spark


def test_contigs_that_share_a_member_are_read_once(spark, tmp_path):
    path = str(tmp_path / "small")
    rows = [(c, f"{c}\t{i}") for c in "abc" for i in range(4)]
    bgzf.write_lines(spark.createDataFrame(rows, "contig string, value string").coalesce(1), path, "value")
    assert sorted(tuple(r) for r in bgzf.read_lines(spark, path, ["a", "c"]).collect()) == sorted(r for r in rows if r[0] != "b")
    assert bgzf.read_lines(spark, path).where("contig = 'a' and contig = 'b'").collect() == []


def test_unknown_contig_warns_and_missing_file_fails(spark, folder):
    with pytest.warns(UserWarning, match="chrUn"):
        assert bgzf.read_lines(spark, folder, ["chrUn"]).collect() == []
    with pytest.raises(FileNotFoundError):
        bgzf.read_lines(spark, folder + "-missing")


def test_without_an_index_the_filter_still_holds(spark, tmp_path):
    path = whole(tmp_path, [b"a\t1\nb\t2\n", b"b\t3\nc\t4\n"])
    assert sorted(r["value"] for r in bgzf.read_lines(spark, path, ["b"]).collect()) == ["b\t2", "b\t3"]


def test_tabix_index(spark, tmp_path):
    texts = [b"chr1\t1\t2\nchr1\t5\t6\n", b"chr2\t20\t30\n", b"chr2\t40\t50\nchr3\t100\t200\n"]
    path = whole(tmp_path, texts)
    starts = [0]
    for t in texts:
        starts.append(starts[-1] + len(bgzf.member(t)))
    chunks = {"chr1": (0, starts[1] << 16), "chr2": (starts[1] << 16, starts[2] << 16 | 11), "chr3": (starts[2] << 16 | 11, starts[3] << 16)}
    names = b"".join(c.encode() + b"\0" for c in chunks)
    body = b"TBI\x01" + struct.pack("<8i", 3, 0x10000, 1, 2, 3, ord("#"), 0, len(names)) + names
    for first, last in chunks.values():
        body += struct.pack("<i", 2) + struct.pack("<IiQQ", 4681, 1, first, last) + struct.pack("<IiQQ", bgzf.TABIX_COUNTS, 1, 3, 99 << 40)
        body += struct.pack("<iQ", 1, first)
    (tmp_path / "one.bed.gz.tbi").write_bytes(bgzf.member(body) + bgzf.END)
    for contig in chunks:
        found = tables.read_intervals(spark, path, contig)
        assert sorted((r["chrom"], r["start"]) for r in found.collect()) == sorted(
            (l.split("\t")[0], int(l.split("\t")[1])) for t in texts for l in t.decode().splitlines() if l.split("\t")[0] == contig
        )
    reader = bgzf.ContigReader(path, 1 << 24)
    list(reader.pushFilters([bgzf.In(("contig",), ("chr2",))]))
    part, = reader.partitions()
    assert (part.begin, part.end) == (starts[1], starts[2] + 1)


def test_variant_file_by_contig(spark, tmp_path):
    head = "##INFO=<ID=CSQ,Description=\"x Format: A|B\">\n##INFO=<ID=SAMPLE>\n#CHROM\tPOS\tINFO\n"
    rows = [f"chr{1 + i // 50}\t{i}\tSAMPLE=s{i};CSQ=a{i}|b" for i in range(200)]
    text = (head + "\n".join(rows) + "\n").encode()
    path = whole(tmp_path, [text[i : i + 500] for i in range(0, len(text), 500)])
    table, header = vcf.read_variants(spark, path)
    assert header.csq_fields == ("A", "B") and len(header.lines) == 3 and table.count() == 200
    one, _ = vcf.read_variants(spark, path, contig="chr2")
    assert sorted(r["A"] for r in one.collect()) == sorted(f"a{i}" for i in range(50, 100))


def test_damaged_member_fails(spark, tmp_path):
    path = whole(tmp_path, [b"a\t1\n" * 50])
    data = bytearray(Path(path).read_bytes())
    data[30] ^= 0xFF
    Path(path).write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|decompress"):
        bgzf.read_lines(spark, path).collect()
