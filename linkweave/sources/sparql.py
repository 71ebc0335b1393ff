"""A Python data source for SPARQL endpoints: paged queries with pauses and retries."""

from __future__ import annotations

import base64
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkweave.sources.readers import TRIPLE_SCHEMA


class Stride(InputPartition):
    """Every n-th page, from the first on."""

    def __init__(self, first: int, step: int):
        super().__init__(first)
        self.first, self.step = first, step


class SparqlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options

    def partitions(self) -> list[Stride]:
        n = int(self.o.get("readers", 1))
        return [Stride(k, n) for k in range(n)]

    def query(self, page: int) -> str:
        size = int(self.o.get("page_size", 1000))
        graph = f"FROM <{self.o['graph']}> " if self.o.get("graph") else ""
        uris = self.o.get("uris", "").split()
        values = f"VALUES ?s {{ {' '.join(f'<{u}>' for u in uris)} }} " if uris else ""
        prop = f"FILTER(?p = <{self.o['property']}>) " if self.o.get("property") else ""
        # several readers see the same order only if there is one
        order = " ORDER BY ?s ?p ?o" if int(self.o.get("readers", 1)) > 1 else ""
        return f"SELECT ?s ?p ?o {graph}WHERE {{ {values}?s ?p ?o . {prop}}}{order} OFFSET {page * size} LIMIT {size}"

    def fetch(self, query: str) -> dict:
        """The endpoint's answer; only failures of input or output are tried again."""
        url = self.o["endpoint"] + "?" + urllib.parse.urlencode({"query": query, "format": "application/sparql-results+json"})
        head = {"Accept": "application/sparql-results+json"}
        if self.o.get("login"):
            head["Authorization"] = "Basic " + base64.b64encode(f"{self.o['login']}:{self.o.get('password', '')}".encode()).decode()
        for left in range(int(self.o.get("retries", 3)), -1, -1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=head)) as r:
                    return json.load(r)
            except OSError:
                if not left:
                    raise
                time.sleep(int(self.o.get("retry_pause_ms", 1000)) / 1000)
        raise AssertionError

    def read(self, partition: Stride) -> Iterator[tuple]:
        size, page, last = int(self.o.get("page_size", 1000)), partition.first, 0.0
        kinds = {"uri": "resource", "bnode": "blank"}
        while True:
            wait = int(self.o.get("pause_ms", 0)) / 1000 - (time.monotonic() - last)
            if last and wait > 0:
                time.sleep(wait)
            last = time.monotonic()
            rows = self.fetch(self.query(page))["results"]["bindings"]
            for r in rows:
                s, o = r["s"], r["o"]
                yield (s["value"], kinds.get(s["type"], "literal"), r["p"]["value"], o["value"], kinds.get(o["type"], "literal"), o.get("xml:lang", ""), o.get("datatype", ""), self.o.get("graph", ""))
            if len(rows) < size:
                return
            page += partition.step


class SparqlDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return TRIPLE_SCHEMA

    def reader(self, schema) -> SparqlReader:
        return SparqlReader(dict(self.options))
