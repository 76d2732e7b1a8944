"""The file scan: what is listed, what is opened, filters that reach the listing."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, LessThanOrEqual, StringStartsWith

from corvane.sources import scan

FILES = {"a.py": "x = 1\n", "src/b.ts": "let é;\n", "src/deep/er/c.js": "f()\n", "src/deep/d.txt": "no", "node_modules/m.js": "no", "src/.git/e.py": "no", "src/big.py": "y" * 2000, "gen/f.py": "z", "README": "no"}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.mkfifo(tmp_path / "gen/pipe.py")  # reading it would never end
    (tmp_path / "loop").symlink_to(tmp_path)
    return str(tmp_path)


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_rules_and_modes(spark, root):
    every = ["a.py", "gen/f.py", "src/b.ts", "src/big.py", "src/deep/er/c.js"]
    assert paths(scan.list_files(spark, root)) == every
    assert paths(scan.list_files(spark, root, max_mb=0.001)) == [p for p in every if p != "src/big.py"]
    assert paths(scan.list_files(spark, root, ["src/*"], ["*.ts"])) == ["src/big.py", "src/deep/er/c.js"]
    assert paths(scan.list_files(spark, root, ["nothing/*"])) == every and paths(scan.list_files(spark, root, ["nothing/*"], mode="configured")) == []
    assert paths(scan.list_files(spark, root, ["nothing/*"], mode="all")) == every
    git = spark.createDataFrame([("a.py",), ("gone.py",), ("README",)], "path string")
    assert paths(scan.list_files(spark, root, mode="git", candidates=git)) == ["a.py"] and paths(scan.list_files(spark, root, mode="git")) == []
    assert paths(scan.list_files(spark, root, languages={".txt": "text"})) == ["src/deep/d.txt"] and paths(scan.list_files(spark, root, most=2)) == every[:2]
    assert paths(scan.list_files(spark, f"{root}/none")) == [] and paths(scan.list_files(spark, f"file://{root}", splits=1)) == every


def test_contents_of_kept_files_only(spark, root):
    listing = scan.list_files(spark, root).where("path <> 'gen/f.py'")
    got = {r.path: (r.text, r.size, r.lang) for r in scan.with_text(listing, root).collect()}
    assert got["src/b.ts"] == ("let é;\n", 8, "typescript") and set(got) == {"a.py", "src/b.ts", "src/big.py", "src/deep/er/c.js"}
    stays = listing.toPandas()
    os.unlink(f"{root}/a.py")
    gone = scan.with_text(spark.createDataFrame(stays), root)
    assert gone.where("text IS NULL").select("path").first().path == "a.py"


def test_filters_reach_the_listing(spark, root):
    some = scan.list_files(spark, root).where(F.startswith("path", F.lit("src/")) & (F.col("size") <= 100) & (F.col("lang") == "javascript"))
    assert paths(some) == ["src/deep/er/c.js"]


def test_folders_that_cannot_matter_are_not_opened(root, monkeypatch):
    opened = []
    listed = scan.FileReader._list
    monkeypatch.setattr(scan.FileReader, "_list", lambda self, fs, base, rel: opened.append(rel) or listed(self, fs, base, rel))

    def run(*filters):
        opened.clear()
        reader = scan.FileReader({"path": root, "exclude": json.dumps([]), "splits": "2"})
        assert len(list(reader.pushFilters(list(filters)))) == len(filters)
        return sorted(p for part in reader.partitions() for p, *_ in reader.read(part)), sorted(opened)

    assert run()[1] == ["", "gen", "src", "src/deep", "src/deep/er"]
    assert run(StringStartsWith(("path",), "src/deep/")) == (["src/deep/er/c.js"], ["", "src", "src/deep", "src/deep/er"])
    assert run(In(("path",), ("gen/f.py", "src/nope.py")), LessThanOrEqual(("size",), 5)) == (["gen/f.py"], ["", "gen", "src"])
    assert run(EqualTo(("lang",), "python"), EqualTo(("path",), "a.py")) == (["a.py"], [""])


def test_files_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.py", "é\n"), ("c.txt", None)], "path string, text string")
    root = str(tmp_path / "out")
    write = lambda df, mode="overwrite": {r.path: (r.size, r.status) for r in scan.write_files(df, root, mode).collect()}
    assert write(rows) == {"a/b.py": (3, "written"), "c.txt": (0, "written")} and (tmp_path / "out/a/b.py").read_text() == "é\n"
    more = spark.createDataFrame([("c.txt", "new"), ("d.txt", "x")], "path string, text string")
    assert write(more, "skip") == {"c.txt": (0, "kept"), "d.txt": (1, "written")} and write(more) == {"c.txt": (3, "written"), "d.txt": (1, "written")}
    for bad, mode in ((more, "error"), (spark.createDataFrame([("../x", "")], "path string, text string"), "overwrite")):
        with pytest.raises(Exception, match="FileExistsError|below the root"):
            write(bad, mode)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "c.txt", "d.txt"]
