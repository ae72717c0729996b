"""Which files of a repository are read: an allow-list of kinds, a share for each kind, and what is left of the budget for manifests."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanline.operators.greedy import decided

# Kind, its place in the order (0 and 1 are manifests), the files of it that are sure of being read, and which
# files are of it: by name, by directory and name, by extension (*.x, in any case), or by a pattern of the path.
KINDS = [
    ("gitattributes", 0, 1, "", r"^\.gitattributes$"),
    ("npm", 1, 60, "package.json", ""),
    ("pnpm-workspace", 1, 2, "pnpm-workspace.yaml", ""),
    ("pyproject", 1, 20, "pyproject.toml", ""),
    ("requirements", 1, 20, "", r"(?:^|/)(?:[\w-]+[-_.])?requirements(?:[-_.][\w.-]+)?\.(?:txt|in)$|(?:^|/)requirements/[^/]+\.(?i:txt|in)$"),
    ("pipfile", 1, 5, "Pipfile", ""),
    ("gomod", 1, 20, "go.mod", ""),
    ("gowork", 1, 2, "go.work", ""),
    ("cargo", 1, 25, "Cargo.toml", ""),
    ("pom", 1, 20, "pom.xml", ""),
    ("gradle", 1, 25, "build.gradle build.gradle.kts", ""),
    ("gradle-settings", 1, 3, "settings.gradle settings.gradle.kts", ""),
    ("gradle-catalog", 1, 3, "libs.versions.toml", ""),
    ("csproj", 1, 25, "*.csproj *.fsproj *.vbproj", ""),
    ("nuget-props", 1, 5, "Directory.Packages.props Directory.Build.props", ""),
    ("composer", 1, 15, "composer.json", ""),
    ("gemfile", 1, 8, "Gemfile", ""),
    ("gemfile-lock", 1, 8, "Gemfile.lock", ""),
    ("pubspec", 1, 8, "pubspec.yaml", ""),
    ("mix", 1, 8, "mix.exs", ""),
    ("swift-package", 1, 10, "Package.swift", ""),
    ("version-file", 1, 30, ".nvmrc .node-version .python-version .python-versions runtime.txt .ruby-version .bun-version .swift-version rust-toolchain rust-toolchain.toml", ""),
    ("tool-versions", 1, 5, ".tool-versions", ""),
    ("env", 2, 10, "", r"(?:^|/)(?:\.env(?:\.[\w-]+)*\.(?:example|sample|template|dist|defaults|tmpl|tpl)|(?:example|sample)\.env|env\.(?:example|sample|template))$"),
    ("github-workflow", 2, 20, "", r"^\.github/workflows/[^/]+\.(?i:ya?ml)$"),
    ("ci", 2, 5, ".gitlab-ci.yml azure-pipelines.yml azure-pipelines.yaml bitbucket-pipelines.yml", r"^\.circleci/config\.yml$"),
    ("compose", 2, 10, "", r"(?:^|/)(?:docker-)?compose(?:\.[\w-]+)*\.ya?ml$"),
    ("prisma", 3, 10, "*.prisma", ""),
    ("drizzle", 3, 5, "drizzle.config.json", r"(?:^|/)drizzle\.config\.(?:[^/]*\.)?(?i:[cm]?js|m?ts)$"),
    ("typeorm", 3, 5, "ormconfig.json", r"(?:^|/)ormconfig\.(?:[^/]*\.)?(?i:ya?ml|[cm]?js|m?ts)$|(?:^|/)data-source\.(?:[^/]*\.)?(?i:[cm]?js|m?ts)$"),
    ("knex", 3, 5, "", r"(?:^|/)knexfile\.(?:[^/]*\.)?(?i:[cm]?js|m?ts)$"),
    ("sequelize", 3, 5, "config/config.json config/database.json", ""),
    ("django-settings", 3, 10, "settings.py", r"(?:^|/)settings/[^/]+\.(?i:py)$"),
    ("alembic", 3, 3, "alembic.ini", ""),
    ("spring-config", 3, 15, "", r"(?:^|/)(?:application|bootstrap)(?:-\w+)?\.(?:properties|ya?ml)$"),
    ("rails-db", 3, 3, "config/database.yml", ""),
    ("laravel-db", 3, 3, "config/database.php", ""),
    ("dotnet-code", 3, 10, "Program.cs Startup.cs", r"Context\.cs$"),
    ("appsettings", 3, 6, "", r"(?:^|/)appsettings(?:\.[\w-]+)?\.json$"),
    ("chart", 4, 10, "Chart.yaml", ""),
    ("dockerfile", 4, 10, "Dockerfile Containerfile", r"(?:^|/)(?:Dockerfile\.[\w.-]+|[\w.-]+\.[Dd]ockerfile)$"),
    ("sam", 4, 3, "template.yaml template.yml", ""),
    ("k8s", 4, 20, "", r"(?:^|/)(?:k8s|kubernetes|manifests|deploy|deployment|deployments|kustomize|helm|charts)/(?:[^/]+/)*[^/]+\.(?i:ya?ml)$"),
    ("terraform", 4, 10, "*.tf", ""),
    ("sql", 5, 5, "*.sql", ""),
]
#: The place in the order up to which a kind is a manifest, and may have more than its share.
MANIFESTS = 1


@dataclass(frozen=True)
class Limits:
    """Fixed values of the operator: files and bytes of a repository that are read, bytes of a file, slashes of its path."""

    files: int = 300
    bytes: int = 16 * 1024 * 1024
    file_bytes: int = 256 * 1024
    depth: int = 6


def _map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def kind_of(path: Column) -> Column:
    """The kind of a file that may be read, null for any other: by its name, its directory and name, its extension, then its path."""
    table = _map((name, kind) for kind, _, _, names, _ in KINDS for name in names.split())
    extension = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    keys = (F.regexp_extract(path, "[^/]*$", 0), F.regexp_extract(path, "[^/]+/[^/]+$", 0), F.concat(F.lit("*"), extension))
    return F.coalesce(*(F.try_element_at(table, key) for key in keys), *(F.when(path.rlike(pattern), F.lit(kind)) for kind, *_, pattern in KINDS if pattern))


def _of_kind(kind: Column, place: int) -> Column:
    return F.try_element_at(_map((row[0], row[place]) for row in KINDS), kind)


#: The order in which files are taken: own shares before spare ones, then kinds, depths and paths.
_ORDER = ["_spare", "_priority", "_depth", "path"]
#: Parts that a repository's spare manifests are dealt to before they meet.
PARTS = 64


def may_be_taken(rows: DataFrame, keys: list[str], limits: Limits, parts: int = PARTS) -> DataFrame:
    """rows without those that no budget of the limits can reach, whatever was taken before; exact.

    A row is left out if limits.files earlier rows of its part are no larger, or if such rows hold more bytes than there
    are: had there been room for it, there had been room for each of them, and they fill the budget. Any part of a
    group shows that, so a group is dealt over parts, and a task holds the limits.files smallest sizes, not the rows.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(parts))).select(*keys, "_part", *(c for c in rows.columns if c not in keys))
    n, names = len(keys) + 1, dealt.columns
    at, schema = names.index("_size"), dealt.schema

    def run(batches):
        group, sizes, held = object(), [], 0  # sizes: a heap of the smallest ones, negated
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(n)] + [batch.column(at).to_pylist()]
            keep = []
            for *key, size in zip(*columns, strict=True):
                if key != group:
                    group, sizes, held = key, [], 0
                full = len(sizes) >= limits.files
                out = (full and -sizes[0] <= size) or (sizes and -sizes[0] <= size and held > limits.bytes)
                keep.append(not out)
                if not out:
                    held += size
                    heapq.heappush(sizes, -size)
                    if full:
                        held += heapq.heappop(sizes)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", *_ORDER).mapInArrow(run, schema).drop("_part")


def pick(files: DataFrame, run: str, limits: Limits = Limits()) -> DataFrame:
    """(run, path, kind): the files of each run that are read. files: run, path, size (bytes; null: not known, counts as none).

    Files of a kind go by depth, then path. Each kind is sure of its share; manifests beyond theirs then use what is
    left of the budget of files and bytes. A file that doesn't fit is passed over, later ones may still fit. Null paths
    are left out, a repeated path is one file (its largest size).

    A share is a bounded rank, which Spark takes before the shuffle. Spare manifests have no bound: a share's last file
    tells them apart, and `may_be_taken` thins them in parts before a run's rows meet.
    """
    depth = F.length(F.regexp_replace("path", "[^/]", ""))
    named = files.filter("path IS NOT NULL").filter(depth <= limits.depth).select(run, "path", "size", kind_of(F.col("path")).alias("kind")).filter("kind IS NOT NULL")
    known = named.groupBy(run, "path", "kind").agg(F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("_size")).filter(F.col("_size") <= limits.file_bytes)
    rows = known.select(run, "path", "kind", "_size", _of_kind(F.col("kind"), 1).alias("_priority"), depth.alias("_depth"))
    rank = F.row_number().over(Window.partitionBy(run, "kind").orderBy("_depth", "path"))
    most = max(row[2] for row in KINDS)
    own = rows.withColumn("_rank", rank).filter(F.col("_rank") <= most).filter(F.col("_rank") <= _of_kind(F.col("kind"), 2))
    full = own.groupBy(run, "kind").agg(F.max("_rank").alias("_n"), F.max(F.struct("_depth", "path")).alias("_last"))
    full = full.filter((F.col("_n") == _of_kind(F.col("kind"), 2)) & (_of_kind(F.col("kind"), 1) <= MANIFESTS))
    last = full.select(F.col(run).alias("_run"), F.col("kind").alias("_kind"), "_last")
    beyond = rows.join(last, F.col(run).eqNullSafe(F.col("_run")) & (F.col("kind") == F.col("_kind"))).filter(F.struct("_depth", "path") > F.col("_last"))
    spare = may_be_taken(beyond.select(run, "path", "kind", "_size", "_priority", "_depth").withColumn("_spare", F.lit(1)), [run], limits)
    both = own.select(run, "path", "kind", "_size", "_priority", "_depth", F.lit(0).alias("_spare")).unionByName(spare)

    def fill(group):
        taken, held = [], 0
        for row in group:
            if len(taken) < limits.files and held + row[at] <= limits.bytes:
                held += row[at]
                taken.append((row[0], row.path, row.kind))
        return taken

    at = both.columns.index("_size")
    return decided(both, [run], _ORDER, f"`{run}` {rows.schema[run].dataType.simpleString()}, path string, kind string", fill)
