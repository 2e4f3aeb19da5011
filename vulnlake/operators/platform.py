"""What a project runs on, from several kinds of evidence: content system by files, PHP minimum, database."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.versions import lower_bound, part, version_key

# Files that show a content system, in order; framework versions and the PHP they need (700 is 7.0).
CMS_FILES = [("WordPress", r"(?:^|/)(?:wp-config\.php$|wp-includes/|wp-content/)"), ("Drupal", r"(?:^|/)(?:core/lib/Drupal\.php$|sites/default/settings\.php$)"), ("Joomla", r"(?:^|/)(?:libraries/joomla/|configuration\.php$)")]
COMPONENTS = [("plugin", r"(?:^|/)wp-content/plugins/([^/]+)/"), ("theme", r"(?:^|/)wp-content/themes/([^/]+)/"), ("module", r"(?:^|/)(?:sites/all/)?modules/([^/]+)/")]
PHP_MINIMA = [("laravel", 10, 801), ("laravel", 9, 800), ("laravel", 8, 703), ("thinkphp", 6, 702), ("yii", 2, 704), ("symfony", 6, 801), ("symfony", 5, 702), ("cakephp", 5, 801),
              ("cakephp", 4, 704), ("codeigniter", 4, 704), ("wordpress", 6, 700), ("drupal", 10, 801), ("drupal", 9, 703)]
#: Database signals by priority: (rank, pattern, type); a type of None is the first group.
DATABASE_SIGNALS = [
    (1, r"'default'\s*=>\s*(?:env\s*\(\s*'DB_CONNECTION'\s*,\s*)?'(mysql|pgsql|sqlite|sqlsrv|mongodb)'", None), (2, r"^\s*DB_CONNECTION\s*=\s*(\w+)", None),
    (4, r"(?i)\bLIMIT\s+\?\s*,\s*\?", "mysql"), (4, r"(?i)\bOFFSET\b.*\bFETCH\b", "pgsql"), (4, r"(?i)\bAUTOINCREMENT\b", "sqlite"),
    (5, r"define\s*\(\s*'DB_(?:HOST|NAME)'", "mysql"), (5, r"\$databases\[", "mysql"), (6, r"MongoDB[\\/]Client", "mongodb"), (6, r"Predis[\\/]Client", "redis"),
]
DEFAULT_DATABASE = "mysql"


def cms_of(files: DataFrame) -> DataFrame:
    """project, cms: the first content system whose files a project has (project, path)."""
    rank, name = F.lit(None), F.lit(None)
    for i, (label, rx) in reversed(list(enumerate(CMS_FILES))):
        rank, name = F.when(F.col("path").rlike(rx), i).otherwise(rank), F.when(F.col("path").rlike(rx), label).otherwise(name)
    return files.groupBy("project").agg(F.min_by(name, rank).alias("cms")).where("cms IS NOT NULL")


def cms_parts(files: DataFrame) -> DataFrame:
    """project, kind, name of plugins, themes and modules by folder."""
    found = F.array_compact(F.array(*[F.when(F.col("path").rlike(rx), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("path", rx, 1).alias("name"))) for kind, rx in COMPONENTS]))
    return files.select("project", F.explode(found).alias("c")).select("project", "c.kind", "c.name").distinct()


def cms_version(lines: DataFrame) -> DataFrame:
    """project, version: ``$wp_version`` as the sources state it; of several the highest."""
    rx = r"\$wp_version\s*=\s*['\x22]([\w.-]+)['\x22]"
    v = lines.where(F.col("code").rlike(rx)).select("project", F.regexp_extract("code", rx, 1).alias("version"))
    return v.groupBy("project").agg(F.max(F.struct(version_key("version"), "version")).alias("v")).select("project", "v.version")


def framework_minimum(framework: Column, major: Column) -> Column:
    """Lowest PHP of a framework's major version; a newer major needs what the newest listed one needs."""
    out = F.lit(None).cast("int")
    for name, since, php in sorted(PHP_MINIMA, key=lambda r: (r[0], r[1])):
        out = F.when((F.lower(framework) == name) & (major >= since), php).otherwise(out)
    return out


def constraint_minimum(rule: Column) -> Column:
    low = lower_bound(rule)
    return (part(low, 0) * 100 + part(low, 1)).cast("int")


def php_minimum(evidence: list[tuple[str, DataFrame]]) -> DataFrame:
    """project, php_min, decided_by: the lowest version that all evidence allows, from (kind, (project, floor)) by priority."""
    rows = reduce(DataFrame.unionByName, [df.where("floor IS NOT NULL").select("project", "floor", F.lit(-i).alias("_p"), F.lit(kind).alias("kind")) for i, (kind, df) in enumerate(evidence)])
    best = rows.groupBy("project").agg(F.max(F.struct("floor", "_p", "kind")).alias("b"))
    return best.select("project", F.col("b.floor").alias("php_min"), F.col("b.kind").alias("decided_by"))


def database_of(lines: DataFrame, require: DataFrame) -> DataFrame:
    """project, db_type, signal: the first signal by priority (1 config, 2 environment, 3 extension, 4 dialect, 5 content system, 6 client, 7 default)."""
    one = lambda rank, rx, kind: F.when(F.col("code").rlike(rx), F.struct(F.lit(rank).alias("signal"), (F.regexp_extract("code", rx, 1) if kind is None else F.lit(kind)).alias("db_type")))
    seen = lines.select("project", F.explode(F.array_compact(F.array(*[one(*s) for s in DATABASE_SIGNALS]))).alias("s"))
    ext = require.where(F.col("package").isin("ext-pdo_mysql", "ext-pdo_pgsql")).select("project", F.struct(F.lit(3).alias("signal"), F.expr("substr(package, 9)").alias("db_type")).alias("s"))
    every = lines.select("project").unionByName(require.select("project")).distinct().select("project", F.struct(F.lit(7).alias("signal"), F.lit(DEFAULT_DATABASE).alias("db_type")).alias("s"))
    return seen.unionByName(ext).unionByName(every).groupBy("project").agg(F.min("s").alias("s")).select("project", "s.db_type", "s.signal")
