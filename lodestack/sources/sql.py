"""SQL pass-through over registered tables, JDBC sources and the catalog."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVERS = {"mysql": ("mysql", 3306), "postgresql": ("postgresql", 5432), "postgres": ("postgresql", 5432), "mssql": ("sqlserver", 1433), "sqlserver": ("sqlserver", 1433)}
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
_LITERAL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`")
_WRITE = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|cache|uncache|refresh|load|msck|set|reset|add|use|call|execute)\b", re.I)


class NotReadOnly(ValueError):
    pass


def check_select(text: str) -> str:
    """The statement, if it is one read-only query; NotReadOnly otherwise."""
    bare = _LITERAL.sub("''", _COMMENT.sub(" ", text)).strip().rstrip(";").strip()
    if ";" in bare or not re.match(r"(?is)(?:\(\s*)*(?:select|with|values|table|from)\b", bare) or _WRITE.search(bare):
        raise NotReadOnly("only one SELECT statement is allowed")
    return _COMMENT.sub(" ", text).strip().rstrip(";")


def run_select(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(check_select(text))


def answer(spark: SparkSession, text: str, limit: int = 1000) -> dict:
    """{rows, count, error} of a statement for a tool that shows at most ``limit`` rows; ``count`` is that of the whole result."""
    try:
        result = run_select(spark, text)
        rows = [r.asDict(recursive=True) for r in result.limit(limit).collect()]
        return {"rows": rows, "count": len(rows) if len(rows) < limit else result.count(), "error": None}
    except Exception as e:  # noqa: BLE001  (any failure is reported to the caller)
        return {"rows": [], "count": 0, "error": str(e).splitlines()[0]}


def parse_connection(uri: str) -> dict:
    """Parts of scheme://user:password@host1:port1,host2/database?options; user and password are decoded."""
    m = re.fullmatch(r"(?P<scheme>[A-Za-z][\w+.-]*)://(?:(?P<user>[^:@/]*)(?::(?P<password>[^@/]*))?@)?(?P<hosts>[^/?]*)(?:/(?P<endpoint>[^?]*))?(?:\?(?P<options>.*))?", uri)
    if not m:
        raise ValueError("not a connection string")
    hosts = []
    for h in filter(None, m["hosts"].split(",")):
        host, _, port = h.partition(":")
        hosts.append({"host": host, "port": int(port) if port.isdigit() else None})
    options = dict(x.partition("=")[::2] for x in filter(None, (m["options"] or "").split("&")))
    return {
        "scheme": m["scheme"], "username": unquote(m["user"]) if m["user"] is not None else None, "password": unquote(m["password"]) if m["password"] is not None else None,
        "hosts": hosts, "endpoint": m["endpoint"] or None, "options": {k: unquote(v) for k, v in options.items()},
    }


def connection_columns(uri: Column) -> list[Column]:
    """The same parts as columns: scheme, username, password, all hosts, the first host and port, endpoint, option ``ssl``; null where absent."""
    def part(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(uri, pattern, group), F.lit(""))

    return [
        part(r"^([A-Za-z][A-Za-z0-9+.-]*)://").alias("scheme"),
        part(r"^[^:]+://([^:@/]*)[^@/]*@").alias("username"),
        part(r"^[^:]+://(?:[^@/]*@)?([^:,/?]+)").alias("host"),
        F.regexp_extract(uri, r"^[^:]+://(?:[^@/]*@)?[^:,/?]+:([0-9]+)", 1).try_cast("int").alias("port"),
        part(r"^[^:]+://[^/?]*/([^?]*)").alias("endpoint"),
        part(r"^[^:]+://(?:[^@/]*@)?([^/?]+)").alias("hosts"),
        F.url_decode(part(r"^[^:]+://[^:@/]*:([^@/]*)@")).alias("password"),
        part(r"[?&]ssl=([^&]*)").alias("ssl"),
    ]


def jdbc_options(uri: str, query: str) -> dict[str, str]:
    """Options of ``spark.read.format('jdbc')`` for a read-only query through a connection string."""
    c = parse_connection(uri)
    if c["scheme"] not in DRIVERS:
        raise ValueError(f"unknown scheme {c['scheme']}")
    name, port = DRIVERS[c["scheme"]]
    hosts = ",".join(f"{h['host']}:{h['port'] or port}" for h in c["hosts"])
    url = f"jdbc:sqlserver://{hosts};databaseName={c['endpoint']}" if name == "sqlserver" else f"jdbc:{name}://{hosts}/{c['endpoint'] or ''}"
    return {"url": url, "query": check_select(query), "user": c["username"] or "", "password": c["password"] or ""}


def read_jdbc(spark: SparkSession, uri: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(uri, query), **options).load()


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.tableType) for t in spark.catalog.listTables()], "name string, kind string")


def table_schema(spark: SparkSession, name: str) -> DataFrame:
    """(column, type, position) of a registered table."""
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), i) for i, f in enumerate(spark.table(name).schema)], "column string, type string, position int")
