"""The query surface over a parsed code base: ten named tools, each a DataFrame.

A `CodeBase` holds DataFrames, not state: files are parsed once into a stored table that all
tools read. `instrument` wraps a tool and appends a row of telemetry to a list of calls.
"""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from skeinworks.functions.text import relative_to, tokens, without_lines
from skeinworks.operators import budget, listing, parse, resolve, search, telemetry, traverse
from skeinworks.session import discard, stored
from skeinworks.sources import files as source_files

log = logging.getLogger("skeinworks")


def instrument(calls: list, name: str, run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """run as an action: its result is stored in its order, and the call is recorded with the
    time that took, the tokens of the rows as JSON, and the engine that parsed them, where rows
    name one. Errors are recorded and raised again."""

    @functools.wraps(run)
    def wrapped(*args, **kwargs):
        began, error, said, engine = time.time(), None, 0, None
        try:
            rows = run(*args, **kwargs)
            # The metrics are observed while the rows are written: a call is one action.
            seen = Observation(f"tool-{name}")
            used = F.sum(tokens(F.to_json(F.struct(*rows.columns))))
            by = F.min("engine") if "engine" in rows.columns else F.min(F.lit(None).cast("string"))
            watched = rows.observe(seen, F.coalesce(used, F.lit(0)).alias("tokens"), by.alias("engine"))
            out = stored(watched.withColumn("__place", F.monotonically_increasing_id()), f"tool-{name}")
            said, engine = seen.get["tokens"], ENGINES.get(seen.get["engine"])
            return out.orderBy("__place").select(*rows.columns)
        except Exception as e:
            error = str(e)[:200]
            raise
        finally:
            asked = len(str(args) + str(kwargs))
            calls.append((len(calls) + 1, name, -(-asked // 4), said, int((time.time() - began) * 1000), engine, False, error, datetime.now(UTC)))
            log.info("%s took %d ms", name, calls[-1][4])

    return wrapped


#: What telemetry calls the engines of `parse.read_skeletons`.
ENGINES = {"scanner": telemetry.TREE[0], "lines": telemetry.STAND_IN[1]}
CALLS = "seq long, tool string, input_tokens long, output_tokens long, ms long, engine string, from_cache boolean, error string, wall_time timestamp"


@dataclass
class CodeBase:
    """sources(path, content, seq) and what is parsed of them."""

    sources: DataFrame
    root: str = "/"
    aliases: DataFrame | None = None
    calls: list = field(default_factory=list)

    @classmethod
    def at(cls, spark: SparkSession, root: str, config_text: str = "{}") -> CodeBase:
        tree = source_files.numbered(source_files.source_tree(spark, root))
        return cls(stored(tree, "sources"), root, source_files.alias_map(spark, config_text))

    def __post_init__(self) -> None:
        found = stored(parse.scanned(self.sources), "scanned")
        # Statements and events; files that the scanner cannot close have the statements of lines.
        self.parsed = stored(parse.with_lines(self.sources, found).join(self.sources.select("path", "seq"), "path"), "parsed")
        discard(found)
        files = self.sources.select("path", "seq")
        order = F.col("seq") * (1 << 20)
        self.files = files
        self.symbols = stored(parse.symbols(self.parsed.drop("seq")).join(files, F.col("file") == F.col("path")).withColumn("seq", order + F.col("pos")).drop("path", "pos"), "symbols")
        self.methods = stored(resolve.last_writer(parse.rpc_methods(self.parsed.drop("seq")).join(files, F.col("file") == F.col("path")).select("name", "file", "seq"), "name", "file", "seq"), "methods")
        self.imports = stored(resolve.imports(parse.import_specs(self.sources), files), "imports").select("src", "dst", "pos", "spec")
        names = parse.import_names(self.sources).join(self.imports.select(F.col("src").alias("file"), "spec", F.col("dst").alias("target")).distinct(), ["file", "spec"])
        self.edges = stored(resolve.call_edges(parse.call_sites(self.sources, self.parsed), names, self.symbols), "edges")
        for name in ("list_files", "read_file_skeleton", "read_symbol_details", "search_symbol", "resolve_method", "resolve_alias", "blast_radius", "repo_stats", "get_scope"):
            setattr(self, name, instrument(self.calls, name, getattr(self, name)))

    def list_files(self, prefix: str | None = None, pattern: str | None = None, max_results: int = 100) -> DataFrame:
        return listing.list_files(self.files, prefix, pattern, max_results)

    def read_file_skeleton(self, path: str, include_imports: bool = True, include_methods: bool = True) -> DataFrame:
        """One row: the skeleton, or an error where the path has no source."""
        wanted = self.sources.sparkSession.createDataFrame([(path,)], "path string")
        here = F.col("path") == path
        rows = parse.read_skeletons(wanted, self.sources.where(here), self.parsed.where(here).drop("seq"))
        if not include_imports:
            rows = rows.withColumn("skeleton", without_lines("skeleton", "import "))
        return rows if include_methods else rows.drop("methods")

    def read_symbol_details(self, path: str, name: str) -> DataFrame:
        """The symbol's source and its numbers of calls; other files with it where it is missing."""
        found = parse.symbol_source(source_files.read_file(self.sources, path), name, parsed=self.parsed.where(F.col("path") == path))
        node = f"{path}::{name}"
        counts = self.edges.agg(F.count_if(F.col("from_id") == node).alias("calls"), F.count_if(F.col("to_id") == node).alias("called_by"))
        others = self.symbols.where((F.col("name") == name) & (F.col("file") != path)).agg(F.sort_array(F.collect_set("file")).alias("candidates"))
        return found.crossJoin(counts).crossJoin(others)  # one row each

    def search_symbol(self, query: str, file_pattern: str | None = None, max_results: int = 15) -> DataFrame:
        return search.search(self.symbols, self.methods, self.files, query, file_pattern, max_results).withColumn("symbols", F.slice("symbols", 1, 5))

    def resolve_method(self, name: str) -> DataFrame:
        return search.lookup(self.methods, name)

    def resolve_alias(self, alias: str) -> DataFrame:
        return search.resolve_alias(self.aliases, alias)

    def blast_radius(self, file: str, symbol: str | None = None, max_depth: int = 4) -> DataFrame:
        """id, depth, folder of what a change reaches: callers of a symbol, or importers."""
        spark = self.sources.sparkSession
        start = f"{file}::{symbol}" if symbol else file
        seeds = spark.createDataFrame([(start,)], "id string")
        if symbol:
            found = traverse.impact(self.edges, seeds, max_depth, "from_id", "to_id", expandable=self.symbols.select(F.col("node_id").alias("id")))
        else:
            found = traverse.impact(self.imports.where("dst IS NOT NULL"), seeds, max_depth)
        from skeinworks.functions.text import path_prefix

        return found.withColumn("folder", path_prefix(F.split_part("id", F.lit("::"), F.lit(1))))

    def repo_stats(self) -> DataFrame:
        spark = self.sources.sparkSession
        stats = telemetry.graph_stats(self.files, self.files, self.symbols, self.imports.where("dst IS NOT NULL"), self.methods)
        return stats.crossJoin(telemetry.efficiency(spark.createDataFrame(self.calls, CALLS), stats))  # one row each

    def get_scope(self, queries: list[str], max_tokens: int = 8000, max_depth: int = 2, max_files: int = 40) -> DataFrame:
        """Ranked files around seeds with their skeletons, as many as fit the token budget."""
        plain = [q.removeprefix(self.root.rstrip("/") + "/") for q in queries]
        seeds = traverse.seed_files(plain, self.files, self.symbols, self.methods)
        ranked = traverse.scope(self.imports.where("dst IS NOT NULL").select("src", "dst", "pos"), seeds, max_depth, max_files)
        ranked = stored(ranked.withColumn("place", F.monotonically_increasing_id()), "scope-files")
        # At most max_files paths: only their sources and statements are read.
        files = F.broadcast(ranked.select(F.col("file").alias("path")))
        shown = parse.skeletons(self.sources.join(files, "path", "left_semi"), self.parsed.drop("seq").join(files, "path", "left_semi"))
        shown = ranked.join(shown.select(F.col("path").alias("file"), "skeleton"), "file").withColumn("tokens", tokens("skeleton"))
        return budget.within_budget(shown, [-F.col("score"), F.col("depth"), F.col("place")], "tokens", max_tokens, ["file", "depth", "score", "reason", "skeleton"])

    def reindex(self) -> CodeBase:
        """The code base read again from its root."""
        return CodeBase.at(self.sources.sparkSession, self.root)


def normalised(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Paths under root as relative ones."""
    return paths.withColumn(path, relative_to(path, root))
