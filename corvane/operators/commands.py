"""Test commands moved into the workspaces that verify them: targets rebased to the workspace's folder.

A command's words are cut at blanks outside quotes; a backslash is an ordinary character, ``..`` and links aren't followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Programs that run pytest by ``-m``, and what a shell takes without quotes.
INTERPRETERS = ("python", "python3", "py")
PLAIN = r"^[A-Za-z0-9_@%+=:,./-]+$"


def words(command: Column) -> Column:
    """The words of a command as a shell cuts them, without their quotes."""
    raw = F.regexp_extract_all(command, F.lit(r"""(?:"[^"]*+"|'[^']*+'|[^\s"']++)++"""), 0)
    plain = lambda w: ~F.contains(w, F.lit('"')) & ~F.contains(w, F.lit("'"))
    return F.transform(raw, lambda w: F.when(plain(w), w).otherwise(F.regexp_replace(w, r""""([^"]*)"|'([^']*)'""", "$1$2")))


def quoted(word: Column) -> Column:
    """A word as a shell reads it back."""
    return F.when(F.regexp_like(word, F.lit(PLAIN)), word).otherwise(F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def first_argument(ws: Column) -> Column:
    """The place (from 1) of pytest's first argument among the words; null if they don't run pytest. ws: a column that is there, as it is read often."""
    low = lambda i: F.lower(F.trim(F.get(ws, i)))
    module = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(ws) - 1)), lambda i: (F.trim(F.get(ws, i - 1)) == "-m") & (low(i) == "pytest"))
    return F.when(F.regexp_like(low(F.lit(0)), F.lit(r"(^|[/\\])pytest$")), 2).when(low(F.lit(0)).isin(*INTERPRETERS), F.get(module, F.lit(0)) + 2)


def existing(files: DataFrame) -> DataFrame:
    """The paths of files and of all folders above them: target, each once."""
    parts = F.split("path", "/")
    return files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("target")).where("target <> ''").distinct()


def targets(commands: DataFrame) -> DataFrame:
    """Words of pytest commands that may be paths: the command's columns without ``ws``, place, target (normal form, before ``::``), node. commands: ws (its words)."""
    kept = [c for c in commands.columns if c != "ws"]
    # Spark pushes filters on the words or on ``first`` below what makes them, and each cuts every command again. So ``first`` is
    # never null and the words are exploded by outer: else it would add such filters of its own.
    c = commands.withColumn("first", F.coalesce(first_argument(F.col("ws")), F.lit((1 << 31) - 1)))
    w = c.select(*kept, "first", F.posexplode_outer("ws").alias("place", "word")).where("place + 1 >= first").withColumn("word", F.trim("word")).where("word <> '' AND word NOT LIKE '-%'")
    cut = F.contains("word", F.lit("::"))
    path, node = F.when(cut, F.trim(F.split_part("word", F.lit("::"), F.lit(1)))).otherwise(F.col("word")), F.when(cut, F.regexp_extract("word", r"::(.*)$", 1)).otherwise("")
    t = w.select(*kept, "place", path.alias("path"), node.alias("node"))
    like = F.endswith(F.lower("path"), F.lit(".py")) | F.startswith("path", F.lit(".")) | F.contains("path", F.lit("/")) | F.contains("path", F.lit("\\"))
    slashes = F.replace("path", F.lit("\\"), F.lit("/"))
    head = F.when(F.startswith(slashes, F.lit("./")), F.regexp_replace(slashes, r"^(\./)+", "")).otherwise(slashes)
    clean = F.when(F.endswith(head, F.lit("/")), F.regexp_replace(head, r"(?<=.)/+$", "")).otherwise(head)
    return t.where(like).select(*kept, "place", clean.alias("target"), "node").where("target <> '' AND target NOT LIKE '../%'")


def route_commands(commands: DataFrame, files: DataFrame) -> DataFrame:
    """Every command as it runs in its workspace: command_id, command, workspace, rebased (targets that were).

    commands: command_id, command, workspace (a folder, ``.`` or blank for the root); files: path, from the root.
    A target that exists below the workspace is written from there; if one exists elsewhere, the command stays at the root.
    Other words, and targets that don't exist, stay; a command is quoted anew only if a target was changed, and gets a
    ``cd`` unless it has one. Paths meet the files by an equi-join; what was found goes back to the commands by two
    64-bit hashes of command and workspace, so their texts aren't sent with each target. Null commands stay null.
    """
    space = F.regexp_replace(F.trim(F.coalesce("workspace", F.lit(""))), r"^\.?$", ".")
    c = commands.select("command_id", "command", space.alias("workspace"))
    c = c.withColumns({"k": F.xxhash64("command", "workspace"), "k2": F.xxhash64(F.lit(1), "workspace", "command")})
    t = targets(c.where("workspace <> '.'").select("k", "k2", "workspace", words(F.col("command")).alias("ws")))
    inside = (F.col("target") == F.col("workspace")) | F.startswith("target", F.concat("workspace", F.lit("/")))
    rest = F.when(F.col("target") == F.col("workspace"), ".").otherwise(F.substring(F.col("target"), F.length("workspace") + 2, F.length("target")))
    moved = F.when(F.col("node") != "", F.concat(rest, F.lit("::"), "node")).otherwise(rest)
    # A target outside its workspace needs no word: the command stays at the root, whatever its other targets are.
    t = t.select("k", "k2", "target", F.when(inside, F.struct("place", moved.alias("word"))).alias("to"))
    found = t.join(existing(files), "target").select("k", "k2", "to")
    of = found.groupBy("k", "k2").agg(F.bool_or(F.col("to").isNull()).alias("at_root"), F.collect_set("to").alias("to"))
    of = of.select("k", "k2", "at_root", F.when(~F.col("at_root"), F.map_from_entries("to")).alias("moved"))
    out = c.join(of, ["k", "k2"], "left")
    root = (F.col("workspace") == ".") | F.coalesce("at_root", F.lit(False))
    there = F.transform(words(F.col("command")), lambda w, i: F.coalesce(F.get(F.array(F.col("moved")), F.lit(0))[i], w))
    out = out.select("command_id", "command", "workspace", root.alias("root"), F.when(root | F.col("moved").isNull(), 0).otherwise(F.size("moved")).alias("rebased"), F.when(~root & F.col("moved").isNotNull(), there).alias("there"))
    ready = F.when(F.col("rebased") > 0, F.array_join(F.transform("there", quoted), " ")).otherwise(F.col("command"))
    out = out.withColumn("ready", ready).withColumn("short", F.trim("ready"))
    cd = F.concat(F.lit('cd "'), F.replace("workspace", F.lit('"'), F.lit('\\"')), F.lit('" && '), "short")
    stays = F.col("root") | (F.col("short") == "") | F.startswith(F.lower("short"), F.lit("cd "))
    return out.select("command_id", F.when(stays, F.col("ready")).otherwise(cd).alias("command"), F.when(F.col("root"), ".").otherwise(F.col("workspace")).alias("workspace"), F.col("rebased").cast("long").alias("rebased"))
