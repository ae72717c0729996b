"""Technologies read out of a repository's files: evidence by names, directories, dependencies and contents, then scores.

Each file, in one pass, gives tokens: its name, its extension, the dependencies it declares, the images,
URL schemes, environment keys and settings in its text. Alternations find them, one pattern for each
kind of token, and an equality join with the table of signals, whose size is that of the code, gives
them their meaning. Packages are directories with a manifest; a file belongs to the nearest above it,
found by equality with its exploded ancestors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.functions.paths import ancestors, directory, language
from gleanline.functions.text import half_up
from gleanline.operators import stack
from gleanline.sources.code import declared

# Technologies by file name, by a pattern for file names, by extension and by a pattern for directories, with their weights.
FILES = {
    "lang.javascript": "jsconfig.json 0.6", "lang.typescript": "tsconfig.json 0.7", "lang.python": "pyproject.toml 0.8, setup.py 0.7, Pipfile 0.8, uv.lock 0.7, poetry.lock 0.7, .python-version 0.6", "lang.php": "composer.json 0.8",
    "lang.java": "pom.xml 0.5, mvnw 0.4, build.gradle 0.4", "lang.kotlin": "build.gradle.kts 0.5", "lang.go": "go.mod 0.9, go.work 0.8", "lang.rust": "Cargo.toml 0.9", "lang.c": "meson.build 0.4", "lang.cpp": "CMakeLists.txt 0.4, conanfile.txt 0.7, vcpkg.json 0.7",
    "lang.ruby": "Gemfile 0.8, .ruby-version 0.6, Rakefile 0.5", "lang.swift": "Package.swift 0.9", "lang.scala": "build.sbt 0.9", "lang.dart": "pubspec.yaml 0.9", "lang.elixir": "mix.exs 0.9", "runtime.node": ".nvmrc 0.7, .node-version 0.7",
    "runtime.deno": "deno.json 0.9, deno.jsonc 0.9, deno.lock 0.8", "runtime.bun": "bun.lock 0.9, bun.lockb 0.9, bunfig.toml 0.9, .bun-version 0.8", "framework.angular": "angular.json 0.8", "framework.nestjs": "nest-cli.json 0.7", "framework.android": "AndroidManifest.xml 0.9", "framework.ios": "Podfile 0.6",
    "infra.docker": "Dockerfile 0.9, Containerfile 0.85, .dockerignore 0.5", "infra.kubernetes": "skaffold.yaml 0.7, Tiltfile 0.6", "infra.helm": "Chart.yaml 0.95", "infra.terraform": ".terraform.lock.hcl 0.9, terragrunt.hcl 0.8", "infra.ansible": "ansible.cfg 0.9", "infra.serverless": "samconfig.toml 0.9", "ci.jenkins": "Jenkinsfile 0.95",
}
FILE_PATTERNS = [
    ("lang.typescript", r"^tsconfig\.[\w.-]+\.json$", 0.5), ("lang.python", r"^(?:[\w-]+[-_.])?requirements(?:[-_.][\w.-]+)?\.(?:txt|in)$", 0.7), ("lang.rust", r"^rust-toolchain(?:\.toml)?$", 0.7), ("lang.sql", r"^V\d+(?:_\d+)*__[\w-]+\.sql$", 0.5), ("lang.sql", r"\.up\.sql$", 0.5),
    ("framework.nextjs", r"^next\.config\.(?:js|mjs|cjs|ts|mts)$", 0.7), ("framework.vue", r"^vue\.config\.(?:js|ts)$", 0.6), ("framework.nuxt", r"^nuxt\.config\.(?:js|mjs|ts)$", 0.7), ("framework.svelte", r"^svelte\.config\.(?:js|mjs|ts)$", 0.7), ("framework.astro", r"^astro\.config\.(?:js|mjs|ts|mts)$", 0.7),
    ("infra.docker", r"^Dockerfile\.[\w.-]+$", 0.85), ("infra.docker", r"^[\w.-]+\.[Dd]ockerfile$", 0.85), ("infra.docker", r"^(?:docker-)?compose(?:\.[\w-]+)*\.ya?ml$", 0.8), ("infra.kubernetes", r"^kustomization\.ya?ml$", 0.9), ("infra.helm", r"^helmfile\.ya?ml$", 0.8), ("infra.ansible", r"^(?:site|playbook[\w-]*)\.ya?ml$", 0.5),
    ("infra.serverless", r"^serverless\.(?:ya?ml|ts|js|json)$", 0.9), ("ci.jenkins", r"^Jenkinsfile\.[\w.-]+$", 0.8), ("ci.azure-pipelines", r"^azure-pipelines(?:[.-][\w-]+)?\.ya?ml$", 0.95),
]
EXTENSIONS = {
    "lang.csharp": ".csproj 0.9, .sln 0.6", "lang.ruby": ".gemspec 0.8", "framework.react": ".tsx 0.35, .jsx 0.35", "framework.vue": ".vue 0.7", "framework.svelte": ".svelte 0.7", "framework.astro": ".astro 0.8", "framework.ios": ".storyboard 0.8, .xib 0.7", "framework.graphql": ".graphql 0.6, .gql 0.6",
    "db.sqlite": ".sqlite 0.4, .sqlite3 0.4", "orm.prisma": ".prisma 0.9", "infra.terraform": ".tf 0.9, .tofu 0.9",
}
DIRECTORIES = [
    ("framework.ios", r"\.xcodeproj$", 0.8), ("framework.ios", r"\.xcworkspace$", 0.7), ("orm.prisma", r"(?:^|/)prisma/migrations$", 0.6), ("infra.kubernetes", r"(?:^|/)(?:k8s|kubernetes)$", 0.6), ("infra.ansible", r"(?:^|/)roles/[\w.-]+/tasks$", 0.6), ("infra.ansible", r"(?:^|/)(?:group_vars|host_vars)$", 0.6),
    ("ci.github-actions", r"^\.github/workflows$", 0.95), ("ci.circleci", r"^\.circleci$", 0.95), ("cloud.supabase", r"(?:^|/)supabase/migrations$", 0.8),
]
# Images by their last parts ('=' before a whole name), URL schemes, and the keys that environment files begin with.
IMAGES = {
    "runtime.node": "node", "runtime.deno": "=denoland/deno", "runtime.bun": "=oven/bun", "db.postgresql": "postgres postgresql postgis pgvector timescaledb timescaledb-ha pgbouncer", "db.mysql": "mysql mysql-server mariadb percona percona-server", "db.sqlserver": "mssql/server mssql-server-linux azure-sql-edge", "db.mongodb": "mongo mongodb mongodb-community-server mongodb-enterprise-server",
    "db.redis": "redis valkey redis-stack redis-stack-server keydb dragonfly", "db.elasticsearch": "elasticsearch opensearch", "db.clickhouse": "clickhouse-server clickhouse", "db.cassandra": "cassandra scylla", "db.dynamodb": "dynamodb-local", "db.neo4j": "neo4j", "db.cockroachdb": "cockroach", "cloud.aws": "localstack", "tool.kafka": "kafka cp-kafka cp-server redpanda", "tool.rabbitmq": "rabbitmq", "tool.nats": "nats",
}
SCHEMES = {"db.postgresql": "postgres postgresql postgis pgsql", "db.mysql": "mysql mysqlx mariadb", "db.sqlite": "sqlite sqlite3 libsql", "db.sqlserver": "sqlserver mssql", "db.oracle": "oracle", "db.mongodb": "mongodb", "db.redis": "redis rediss valkey valkeys", "db.clickhouse": "clickhouse", "db.neo4j": "neo4j bolt", "db.cockroachdb": "cockroachdb", "tool.kafka": "kafka", "tool.rabbitmq": "amqp amqps", "tool.nats": "nats"}
ENVIRONMENT = {
    "db.postgresql": "POSTGRES_ PGHOST PGUSER PGDATABASE PGPASSWORD PGPORT", "db.mysql": "MYSQL_ MARIADB_", "db.sqlserver": "MSSQL_ SQLSERVER_", "db.mongodb": "MONGO_ MONGODB_", "db.redis": "REDIS_ VALKEY_ UPSTASH_REDIS_", "db.elasticsearch": "ELASTICSEARCH_ ELASTIC_ OPENSEARCH_", "db.clickhouse": "CLICKHOUSE_", "db.cassandra": "CASSANDRA_ SCYLLA_", "db.dynamodb": "DYNAMODB_ DYNAMO_",
    "db.neo4j": "NEO4J_", "db.cockroachdb": "COCKROACH_", "cloud.aws": "AWS_", "cloud.gcp": "GOOGLE_CLOUD_ GCP_ GCLOUD_ GOOGLE_APPLICATION_CREDENTIALS", "cloud.azure": "AZURE_", "cloud.firebase": "FIREBASE_", "cloud.supabase": "SUPABASE_", "tool.kafka": "KAFKA_", "tool.rabbitmq": "RABBITMQ_ AMQP_", "tool.sqs": "SQS_", "tool.nats": "NATS_", "ai.llm": "OPENAI_ ANTHROPIC_ GEMINI_API_KEY MISTRAL_API_KEY COHERE_API_KEY GROQ_API_KEY",
}
ENVIRONMENT_WEIGHT, ENVIRONMENT_WEIGHTS = 0.4, {"cloud.supabase": 0.5}
PUBLIC_PREFIXES = "NEXT_PUBLIC_ NUXT_PUBLIC_ VITE_ REACT_APP_ EXPO_PUBLIC_ PUBLIC_".split()
# Dependencies by ecosystem, with their weights (a second number: where they are for development only).
DEPENDENCIES = {
    "npm": {"lang.typescript": "typescript 0.7 0.7", "runtime.node": "express 0.85, fastify 0.85, koa 0.85, @nestjs/core 0.85, next 0.6 0.6, nuxt 0.6 0.6, @types/node 0.4 0.4", "framework.react": "react 0.9, react-dom 0.8, @vitejs/plugin-react 0.6 0.6", "framework.nextjs": "next 0.95", "framework.vue": "vue 0.9, @vitejs/plugin-vue 0.7 0.7", "framework.nuxt": "nuxt 0.95 0.9", "framework.angular": "@angular/core 0.95, @angular/cli 0.6 0.6", "framework.svelte": "svelte 0.9 0.8, @sveltejs/kit 0.95 0.9", "framework.astro": "astro 0.95 0.9", "framework.solid": "solid-js 0.9", "framework.react-native": "react-native 0.95, expo 0.9", "framework.electron": "electron 0.9 0.9", "framework.express": "express 0.9", "framework.fastify": "fastify 0.9", "framework.koa": "koa 0.9", "framework.hono": "hono 0.9", "framework.nestjs": "@nestjs/core 0.95, @nestjs/common 0.9", "infra.kubernetes": "@kubernetes/client-node 0.6", "infra.terraform": "cdktf 0.7", "infra.serverless": "serverless 0.9 0.8", "ai.llm": "@openai/agents 0.9, ai 0.8"},
    "pypi": {"infra.kubernetes": "kubernetes 0.6", "infra.ansible": "ansible 0.8, ansible-core 0.8", "ai.llm": "openai 0.9, anthropic 0.9, langchain 0.9, litellm 0.9, llama-index 0.9, google-genai 0.9, mistralai 0.9, cohere 0.9, ollama 0.9, groq 0.9, instructor 0.7, mcp 0.8, pydantic-ai 0.8, crewai 0.8, dspy 0.8"},
    "go": {"infra.kubernetes": "k8s.io/client-go 0.7, sigs.k8s.io/controller-runtime 0.8"},
    "cargo": {"db.postgresql": "tokio-postgres 0.9, postgres 0.9, deadpool-postgres 0.9", "ai.llm": "async-openai 0.9"},
    "maven": {"db.postgresql": "org.postgresql:postgresql 0.9, org.postgresql:r2dbc-postgresql 0.9, io.r2dbc:r2dbc-postgresql 0.9", "infra.kubernetes": "io.fabric8:kubernetes-client 0.6"},
    "nuget": {"db.postgresql": "npgsql 0.9, npgsql.entityframeworkcore.postgresql 0.9", "ai.llm": "openai 0.9, azure.ai.openai 0.9"},
    "composer": {"db.postgresql": "ext-pgsql 0.9, ext-pdo_pgsql 0.9", "ai.llm": "openai-php/client 0.9"},
    "gem": {"db.postgresql": "pg 0.9", "ai.llm": "ruby-openai 0.9, langchainrb 0.9"}, "pub": {"framework.flutter": "flutter 0.95", "db.postgresql": "postgres 0.8"}, "hex": {"db.postgresql": "postgrex 0.9"},
}
ECOSYSTEMS = {"npm": r"^package\.json$", "pypi": r"^requirements[^/]*\.txt$", "go": r"^go\.mod$", "cargo": r"^Cargo\.toml$", "maven": r"^pom\.xml$|^build\.gradle(?:\.kts)?$", "nuget": r"\.csproj$", "composer": r"^composer\.json$", "gem": r"^Gemfile$", "pub": r"^pubspec\.yaml$", "hex": r"^mix\.exs$"}
# Settings that name a database or provider: (rule, kinds of files, pattern, weight, value to technology).
_PG, _MY, _LITE, _MS, _ORA, _MONGO, _CRDB = "db.postgresql", "db.mysql", "db.sqlite", "db.sqlserver", "db.oracle", "db.mongodb", "db.cockroachdb"
SETTINGS = [
    ("prisma-provider", ("prisma",), r'(?m)^\s*provider\s*=\s*"(\w+)"', 0.95, {"postgresql": _PG, "postgres": _PG, "mysql": _MY, "sqlite": _LITE, "sqlserver": _MS, "mongodb": _MONGO, "cockroachdb": _CRDB}),
    ("drizzle-dialect", ("drizzle",), r"\bdialect\s*:\s*['\"](\w+)['\"]", 0.95, {"postgresql": _PG, "mysql": _MY, "sqlite": _LITE, "turso": _LITE, "singlestore": _MY, "mssql": _MS, "cockroach": _CRDB}),
    ("knex-client", ("knex",), r"\bclient\s*:\s*['\"]([\w-]+)['\"]", 0.9, {"pg": _PG, "postgres": _PG, "postgresql": _PG, "mysql": _MY, "mysql2": _MY, "sqlite3": _LITE, "better-sqlite3": _LITE, "mssql": _MS, "oracledb": _ORA, "cockroachdb": _CRDB}),
    ("django-engine", ("django-settings",), r"\bdjango\.(?:contrib\.gis\.)?db\.backends\.(\w+)", 0.95, {"postgresql": _PG, "postgresql_psycopg2": _PG, "postgis": _PG, "mysql": _MY, "sqlite3": _LITE, "spatialite": _LITE, "oracle": _ORA}),
    ("jdbc-url", ("spring-config",), r"\bjdbc:(?:tc:)?(\w+):", 0.95, {"postgresql": _PG, "mysql": _MY, "mariadb": _MY, "sqlserver": _MS, "oracle": _ORA, "sqlite": _LITE, "clickhouse": "db.clickhouse", "ch": "db.clickhouse", "cockroach": _CRDB}),
    ("spring-property", ("spring-config",), r"(?m)^\s*spring\.(?:data\.)?(mongodb|redis|elasticsearch|cassandra|neo4j|kafka|rabbitmq|jpa)\.", 0.8, {"mongodb": _MONGO, "redis": "db.redis", "elasticsearch": "db.elasticsearch", "cassandra": "db.cassandra", "neo4j": "db.neo4j", "kafka": "tool.kafka", "rabbitmq": "tool.rabbitmq", "jpa": "orm.hibernate"}),
    ("rails-adapter", ("rails-db",), r"(?m)^\s*adapter:\s*['\"]?(\w+)", 0.95, {"postgresql": _PG, "postgis": _PG, "mysql2": _MY, "trilogy": _MY, "sqlite3": _LITE, "sqlserver": _MS, "oracle_enhanced": _ORA, "cockroachdb": _CRDB}),
    ("db-connection", ("env",), r"(?m)^\s*(?:export\s+)?DB_CONNECTION\s*=\s*['\"]?(\w+)", 0.9, {"pgsql": _PG, "mysql": _MY, "mariadb": _MY, "sqlite": _LITE, "sqlsrv": _MS, "mongodb": _MONGO}),
    ("terraform-provider", ("terraform",), r'(?m)^\s*provider\s+"([\w-]+)"', 0.8, {"aws": "cloud.aws", "google": "cloud.gcp", "google-beta": "cloud.gcp", "azurerm": "cloud.azure", "azuread": "cloud.azure"}),
]
IMPLIES = {"framework.nextjs": "framework.react", "framework.remix": "framework.react", "framework.react-native": "framework.react", "framework.nuxt": "framework.vue", "framework.flutter": "lang.dart", "infra.helm": "infra.kubernetes", "cloud.supabase": "db.postgresql"}
# Kinds of files whose text is read, weights by kind, sample directories, manifests, names of tools' own files.
KINDS = [
    ("env", r"(?:^|/)\.env(?:\.[\w.-]+)?$"), ("compose", r"(?:^|/)(?:docker-)?compose(?:\.[\w-]+)*\.ya?ml$"), ("github-workflow", r"^\.github/workflows/[^/]+\.ya?ml$"), ("ci", r"(?:^|/)(?:\.gitlab-ci\.yml|azure-pipelines\.ya?ml|bitbucket-pipelines\.yml)$"), ("dockerfile", r"(?:^|/)(?:Dockerfile|Containerfile)(?:\.[\w.-]+)?$"),
    ("k8s", r"(?:^|/)(?:k8s|kubernetes)/(?:[^/]+/)*[^/]+\.ya?ml$"), ("prisma", r"\.prisma$"), ("drizzle", r"(?:^|/)drizzle\.config\.[\w]+$"), ("knex", r"(?:^|/)knexfile\.\w+$"), ("django-settings", r"(?:^|/)settings\.py$"), ("spring-config", r"(?:^|/)application(?:-[\w-]+)?\.(?:properties|ya?ml)$"), ("rails-db", r"(?:^|/)config/database\.yml$"),
    ("alembic", r"(?:^|/)alembic\.ini$"), ("appsettings", r"(?:^|/)appsettings(?:\.\w+)?\.json$"), ("terraform", r"\.(?:tf|tofu)$"),
]
IMAGE_WEIGHT = {"compose": 0.8, "ci": 0.6, "github-workflow": 0.6, "dockerfile": 0.5, "k8s": 0.5}
SCHEME_WEIGHT = {"env": 0.7, "spring-config": 0.8, "alembic": 0.8, "rails-db": 0.8, "compose": 0.6, "appsettings": 0.6, "django-settings": 0.5, "github-workflow": 0.5, "ci": 0.5, "k8s": 0.5}
SAMPLES = "examples example samples sample demo demos docs doc documentation".split()
MANIFESTS = "package.json deno.json deno.jsonc pnpm-workspace.yaml pyproject.toml setup.py setup.cfg Pipfile go.mod go.work Cargo.toml pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts build.sbt composer.json Gemfile pubspec.yaml mix.exs Package.swift".split()
TOOLING = r"\.gradle\.kts$|\.config\.[cm]?[jt]s$|^\.[\w.-]*rc\.[cm]?js$|^Dangerfile\.[jt]s$"
LANGUAGES = "typescript javascript python php java kotlin csharp go rust c cpp ruby swift scala dart elixir shell sql".split()
#: Technologies that hold for the whole repository when found at its root.
WIDE = r"^(?:infra|ci|cloud)\."
ROOT = "."


@dataclass(frozen=True)
class Signals:
    """The tables that give tokens their meaning. Further ones go behind them: (kind, token, technology, signal, weight, weight for development)."""

    more: tuple = field(default=())

    def rows(self) -> list[tuple]:
        pairs = lambda table: ((tech, *item.split()) for tech, items in table.items() for item in items.split(", "))
        out = [("file", name, tech, f"file:{name}", float(w), None) for tech, name, w in pairs(FILES)]
        out += [("pattern", p, tech, f"pattern:{p}", w, None) for tech, p, w in FILE_PATTERNS] + [("dir", p, tech, f"dir:{p}", w, None) for tech, p, w in DIRECTORIES]
        out += [("ext", e, tech, f"ext:{e}", float(w), None) for tech, e, w in pairs(EXTENSIONS)]
        out += [(kind, name, tech, kind, 1.0, None) for kind, table in (("image", IMAGES), ("scheme", SCHEMES)) for tech, names in table.items() for name in names.split()]
        out += [("env", key, tech, "env", ENVIRONMENT_WEIGHTS.get(tech, ENVIRONMENT_WEIGHT), None) for tech, keys in ENVIRONMENT.items() for key in keys.split()]
        for eco, table in DEPENDENCIES.items():
            out += [("dep", f"{eco}:{name}", tech, f"dep:{eco}:{name}", float(w), float(dev[0]) if dev else min(float(w), 0.5)) for tech, name, w, *dev in pairs(table)]
        out += [("setting", f"{rule}:{value}", tech, f"setting:{rule}", w, None) for rule, _, _, w, values in SETTINGS for value, tech in values.items()]
        return [*out, *self.more]

    def frame(self, spark: SparkSession) -> DataFrame:
        return F.broadcast(spark.createDataFrame(self.rows(), "kind string, token string, tech string, signal string, weight double, weight_dev double"))


def _any(words: list[str]) -> str:
    import re

    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def sample(of: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(of), "/", -1), F.array(*map(F.lit, SAMPLES)))


def packages(files: DataFrame) -> DataFrame:
    """(repo, dir, package): each directory of files (repo, file) or above one, with the nearest directory at or above it that holds a manifest; '.' is the root."""
    base, home = F.regexp_extract("file", "([^/]*)$", 1), directory(F.col("file"))
    inside = home.rlike("(?:^|/)requirements$")
    listed = base.rlike(FILE_PATTERNS[1][1]) | (inside & base.rlike(r"\.(?:txt|in)$"))
    root = F.when(listed & inside, directory(home)).when(listed | base.isin(*MANIFESTS) | base.rlike(r"\.(?:cs|fs|vb)proj$"), home)
    roots = files.select("repo", root.alias("_up")).filter("_up IS NOT NULL").distinct()
    held = files.select("repo", home.alias("_d")).distinct()
    dirs = held.select("repo", F.explode(F.concat(F.array(F.lit(ROOT)), ancestors(F.col("_d")))).alias("dir")).distinct()
    ups = dirs.select("repo", "dir", F.explode(ancestors(F.col("dir"))).alias("_up")).join(roots, ["repo", "_up"])
    nearest = ups.groupBy("repo", "dir").agg(F.max_by("_up", F.length("_up")).alias("_up"))
    return dirs.join(nearest, ["repo", "dir"], "left").select("repo", "dir", F.coalesce("_up", F.lit(ROOT)).alias("package"))


def _images(text: Column, kind: Column) -> Column:
    """Image references: `image:` keys, and what a Dockerfile builds FROM, with the values of the ARGs before it."""
    keyed = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t-]*image[ \t]*:[ \t]*['\"]?([^\s'\"#]+)"), F.lit(1))
    head = F.regexp_extract(text, r"(?is)\A(.*?)(?:^|\n)[ \t]*FROM[ \t]", 1)
    names, values = (F.regexp_extract_all(head, F.lit(r"(?im)^[ \t]*ARG[ \t]+(\w+)=['\"]?([^\s'\"]*)"), F.lit(k)) for k in (1, 2))
    refs = F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*FROM[ \t]+(?:--platform=\S+[ \t]+)?(\S+)"), F.lit(1))
    filled = F.transform(refs, lambda r: F.aggregate(F.arrays_zip(names.alias("n"), values.alias("v")), r, lambda a, x: F.replace(F.regexp_replace(a, F.concat(F.lit(r"\$\{"), x["n"], F.lit(r"(?::?-[^}]*)?\}")), F.concat(F.lit(r"\${"), x["n"], F.lit("}"))), F.concat(F.lit("${"), x["n"], F.lit("}")), x["v"])))
    return F.when(kind == "dockerfile", F.transform(filled, lambda r: F.regexp_replace(r, r"\$\{\w+:?-([^}]*)\}", "$1"))).otherwise(keyed)


def image_name(ref: Column) -> Column:
    """An image's name without registry, library/, tag and digest."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(ref)), "@.*$", ""), ":[^/]*$", "")
    return F.regexp_replace(F.regexp_replace(name, r"^(?:[^/]*[.:][^/]*|localhost)/", ""), "^library/", "")


def tokens(files: DataFrame) -> DataFrame:
    """(repo, dir, file, kind, token, factor, dev): what each file (repo, file, content) says, token by token; a null content is only looked at by name."""
    rows = files.select("repo", "file", directory(F.col("file")).alias("dir"), F.regexp_extract("file", "([^/]*)$", 1).alias("base"), "content")
    rows = rows.withColumn("of", F.coalesce(*(F.when(F.col("file").rlike(p), F.lit(k)) for k, p in KINDS)))
    text, of = F.col("content"), F.col("of")
    token = lambda kind, value, factor=1.0, dev=None: F.struct(F.lit(kind).alias("kind"), value.alias("token"), (F.lit(factor) if isinstance(factor, float) else factor).alias("factor"), (F.lit(False) if dev is None else dev).alias("dev"))
    by_kind = lambda table: F.coalesce(*(F.when(of == k, F.lit(w)) for k, w in table.items()))
    none = F.array().cast("array<struct<kind:string,token:string,factor:double,dev:boolean>>")
    patterns = F.when(F.col("base").rlike("|".join(f"(?:{p})" for _, p, _ in FILE_PATTERNS)), F.filter(F.array(*(F.when(F.col("base").rlike(p), token("pattern", F.lit(p))) for _, p, _ in FILE_PATTERNS)), lambda t: t.isNotNull()))
    extension = F.lower(F.regexp_extract("base", r"^.+(\.[^.]+)$", 1))
    named = F.array(token("file", F.col("base")), token("ext", extension))
    eco = F.coalesce(*(F.when(F.col("base").rlike(p), F.lit(e)) for e, p in ECOSYSTEMS.items()))
    deps = F.transform(declared(F.col("file"), text), lambda d: token("dep", F.concat(eco, F.lit(":"), F.when(eco == "nuget", F.lower(d["name"])).otherwise(d["name"])), 1.0, d["scope"] != "main"))
    parts = lambda name: F.split(name, "/", -1)
    ends = lambda name: F.array_distinct(F.array(F.concat(F.lit("="), name), F.element_at(parts(name), -1), F.array_join(F.slice(parts(name), F.greatest(F.size(parts(name)) - 1, F.lit(1)), 2), "/")))
    images = F.when(of.isin(*IMAGE_WEIGHT), F.transform(F.flatten(F.transform(_images(text, of), lambda r: ends(image_name(r)))), lambda n: token("image", n, by_kind(IMAGE_WEIGHT))))
    known = [s for names in SCHEMES.values() for s in names.split()]
    scanned = F.when(of == "env", F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:export\s+)?[A-Za-z_]\w*\s*=\s*(.*)$"), F.lit(1)), "\n")).otherwise(text)
    schemes = F.when(of.isin(*SCHEME_WEIGHT), F.transform(F.array_distinct(F.transform(F.regexp_extract_all(scanned, F.lit(rf"(?i)\b({_any(known)})(?:\+[a-z0-9]+)?://"), F.lit(1)), F.lower)), lambda s: token("scheme", s, by_kind(SCHEME_WEIGHT))))
    keys = [k for names in ENVIRONMENT.values() for k in names.split()]
    env = F.when(of == "env", F.transform(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?im)^\s*(?:export\s+)?(?:{_any(PUBLIC_PREFIXES)})?({_any(keys)})\w*\s*="), F.lit(1)), F.upper)), lambda k: token("env", k)))
    values = lambda rule, p: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda v: F.concat(F.lit(f"{rule}:"), F.lower(v))))
    settings = [F.when(of.isin(*kinds), F.transform(values(rule, p), lambda v: token("setting", v))) for rule, kinds, p, _, _ in SETTINGS]
    found = F.concat(named, *(F.coalesce(x, none) for x in (patterns, deps, images, schemes, env, *settings)))
    # never empty; the outer form keeps the optimizer from evaluating it all once more in a filter
    return rows.select("repo", "dir", "file", F.explode_outer(found).alias("t")).select("repo", "dir", "file", "t.*")


def language_evidence(files: DataFrame, of_dir: DataFrame) -> DataFrame:
    """(repo, package, tech, signal, weight) from the counts of code files: 10 files weigh 0.9, 3 (or 2 that are half of all) 0.75, fewer 0.45; samples count apart."""
    base = F.regexp_extract("file", "([^/]*)$", 1)
    rows = files.select("repo", directory(F.col("file")).alias("dir"), language(F.col("file")).alias("lang"), base.rlike(TOOLING).alias("tool")).filter(F.col("lang").isin(*LANGUAGES) & ~F.col("tool"))
    by_dir = rows.groupBy("repo", "dir", "lang").agg(F.count(F.lit(1)).alias("n")).join(of_dir, ["repo", "dir"])
    counts = by_dir.groupBy("repo", "package", "lang").agg(F.sum(F.when(~sample(F.col("dir")), F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(sample(F.col("dir")), F.col("n")).otherwise(0)).alias("samples"))
    from pyspark.sql.window import Window

    counts = counts.withColumn("all", F.sum("own").over(Window.partitionBy("repo", "package")))
    weight = lambda n, half: F.when(n >= 10, 0.9).when((n >= 3) | ((n >= 2) & half), 0.75).otherwise(0.45)
    both = F.array(F.struct(F.lit("lang").alias("signal"), F.col("own").alias("n"), weight(F.col("own"), 2 * F.col("own") >= F.col("all")).alias("weight")), F.struct(F.lit("lang:samples").alias("signal"), F.col("samples").alias("n"), (weight(F.col("samples"), F.lit(False)) * stack.SAMPLE).alias("weight")))
    return counts.select("repo", "package", F.concat(F.lit("lang."), "lang").alias("tech"), F.explode(F.filter(both, lambda x: x["n"] > 0)).alias("e")).select("repo", "package", "tech", "e.signal", "e.weight")


def evidence(files: DataFrame, signals: Signals | None = None) -> DataFrame:
    """(repo, package, tech, signal, weight, wide): the strongest weight of each signal; wide ones hold for every package of their repository. files: repo, file, content."""
    meaning, of_dir = (signals or Signals()).frame(files.sparkSession), packages(files)
    dirs = of_dir.select("repo", "dir", F.lit("").alias("file"), F.explode(F.filter(F.array(*(F.when(F.col("dir").rlike(p), F.lit(p)) for _, p, _ in DIRECTORIES)), lambda p: p.isNotNull())).alias("token")).select("repo", "dir", "file", F.lit("dir").alias("kind"), "token", F.lit(1.0).alias("factor"), F.lit(False).alias("dev"))
    met = tokens(files).unionByName(dirs).join(meaning, ["kind", "token"])
    weight = F.when(F.col("dev"), F.col("weight_dev")).otherwise(F.col("weight")) * F.col("factor") * F.when(sample(F.col("dir")), stack.SAMPLE).otherwise(1.0)
    # the signal of an image or a scheme is one for each place that it is found in
    signal = F.when(F.col("kind").isin("image", "scheme"), F.concat_ws("@", "signal", F.col("factor").cast("string"))).otherwise(F.col("signal"))
    strongest = met.groupBy("repo", "dir", "tech", "kind", signal.alias("signal")).agg(F.max(weight).alias("weight"))
    placed = strongest.join(of_dir, ["repo", "dir"])
    wide = (F.col("package") == ROOT) & (F.col("tech").rlike(WIDE) & ~F.col("kind").isin("image", "scheme", "env") | F.col("kind").isin("image", "scheme", "env") | ((F.col("kind") == "setting") & F.col("signal").isin(*(f"setting:{rule}" for rule, kinds, *_ in SETTINGS if kinds == ("env",)))))
    own = placed.select("repo", "package", "tech", "signal", "weight", wide.alias("wide"))
    return own.unionByName(language_evidence(files, of_dir).withColumn("wide", F.lit(False))).groupBy("repo", "package", "tech", "signal", "wide").agg(F.max("weight").alias("weight"))


def detect(files: DataFrame, signals: Signals | None = None) -> DataFrame:
    """(repo, package, tech, score, active): technologies with a score of at least WEAK in each package of files (repo, file, content); '.' is the root."""
    from gleanline.operators.graph import cut

    found = cut(evidence(files, signals))
    all_packages = packages(files).select("repo", "package").unionByName(files.select("repo", F.lit(ROOT).alias("package"))).distinct()
    # a repository has at most a row a signal of wide evidence, whatever its size
    spread = found.filter("wide").drop("package").join(all_packages, "repo")
    rows = found.filter("NOT wide").unionByName(spread).select(F.struct("repo", "package").alias("package"), "tech", "signal", "weight", F.lit(False).alias("sample"))
    implications = F.broadcast(files.sparkSession.createDataFrame(list(IMPLIES.items()), "tech string, implies string"))
    scored = stack.implied(stack.tech_scores(rows), implications).withColumn("score", half_up(F.col("score"), 3)).filter(F.col("score") >= stack.WEAK)
    return scored.select("package.repo", "package.package", "tech", "score", (F.col("score") >= stack.ACTIVE).alias("active"))
