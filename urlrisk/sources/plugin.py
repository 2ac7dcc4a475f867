"""Foreign lookup sources as Spark data sources.

A source is a class with ``partitions`` and ``read``; ``register`` makes it a format of
``spark.read`` that has the columns the enrichment jobs read.  Partitions are read in
parallel by the executors.  Every row is checked there: a column that the jobs don't
know or a value of another kind is an error that names the source, a missing column is
null.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Sources travel to the executors inside the job, so that these need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns of each kind of snapshot, as the enrichment jobs read them.
SCHEMAS = {
    "whois": ("domain string, domain_name array<string>, registrar string, creation_date array<string>, expiration_date array<string>, updated_date array<string>, "
              "name_servers array<string>, name string, org string, emails array<string>, country string, state string, city string, "
              "registrant_name string, registrant_organization string"),
    "dns": "domain string, rtype string, value string, status string, ttl int, priority int",
    "reputation": "domain string, source string, isMalicious boolean, confidence double, category string",
}
_KINDS = {"string": (str,), "int": (int,), "double": (int, float), "boolean": (bool,), "timestamp": (datetime.datetime,), "array<string>": (list, tuple)}


def columns(kind: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in SCHEMAS[kind].split(",")]


class SnapshotSource:
    """Base of a foreign source; ``options`` are those of ``spark.read``."""

    kind = "whois"

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[object]:
        """Parts that can be read on their own."""
        raise NotImplementedError

    def read(self, part: object) -> Iterator[dict]:
        """Rows of one part, by column name."""
        raise NotImplementedError


def checked(row: dict, wanted: list[tuple[str, str]], name: str) -> tuple:
    """The values of a row in the order of the columns."""
    if unknown := sorted(set(row) - {c for c, _ in wanted}):
        raise ValueError(f"source {name}: unknown columns {unknown}")
    for column, kind in wanted:
        value = row.get(column)
        fits = value is None or isinstance(value, _KINDS[kind]) and not (kind in ("int", "double") and isinstance(value, bool))
        if not fits or kind == "array<string>" and value is not None and not all(v is None or isinstance(v, str) for v in value):
            raise ValueError(f"source {name}: {column} is {value!r}, not {kind}")
    return tuple(list(row[c]) if kind == "array<string>" and row.get(c) is not None else row.get(c) for c, kind in wanted)


class _Part(InputPartition):
    def __init__(self, value: object):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, source: SnapshotSource, name: str):
        self.source, self.name = source, name

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.source.partitions()]

    def read(self, partition: _Part) -> Iterator[tuple]:
        wanted = columns(self.source.kind)
        for row in self.source.read(partition.value):
            yield checked(row, wanted, self.name)


def register(spark: SparkSession, name: str, source: type[SnapshotSource]) -> None:
    """Make a source the format ``name`` of ``spark.read``."""
    if source.kind not in SCHEMAS:
        raise ValueError(f"source {name}: kind must be one of {sorted(SCHEMAS)}")

    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMAS[source.kind]

        def reader(self, schema) -> DataSourceReader:
            return _Reader(source(dict(self.options)), name)

    spark.dataSource.register(Format)


class WhoisText(SnapshotSource):
    """WHOIS answers as text: lines ``field: value``, a blank line after each answer; a field that repeats is a list.

    ``path`` is a folder of such files; each file is a part.
    """

    kind = "whois"
    FIELDS = {
        "Query": "domain", "Domain Name": "domain_name", "Registrar": "registrar", "Creation Date": "creation_date", "Registry Expiry Date": "expiration_date",
        "Updated Date": "updated_date", "Name Server": "name_servers", "Registrant Name": "name", "Registrant Organization": "org",
        "Registrant Email": "emails", "Registrant Country": "country", "Registrant State": "state", "Registrant City": "city",
    }

    def _files(self):
        from pyarrow import fs
        return fs.FileSystem.from_uri(self.options["path"])

    def partitions(self) -> Sequence[object]:
        from pyarrow import fs
        files, root = self._files()
        found = files.get_file_info(fs.FileSelector(root))
        return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def read(self, part: object) -> Iterator[dict]:
        import io
        lists = {c for c, kind in columns(self.kind) if kind == "array<string>"}
        files, _ = self._files()
        row: dict = {}
        with files.open_input_stream(part) as raw:
            for line in io.TextIOWrapper(raw, "utf-8"):
                field, found, value = line.rstrip("\n").partition(": ")
                if not line.strip():
                    if row:
                        yield row
                    row = {}
                elif found and (column := self.FIELDS.get(field)):
                    if column in lists:
                        row.setdefault(column, []).append(value)
                    else:
                        row[column] = value
        if row:
            yield row
