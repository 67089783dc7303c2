"""A disclosure service behind an injected `get`, and its paged listing as a Spark data source.

`get(url, params) -> (content bytes)`; there is no network code here."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Status codes of the service.
FINE, NO_DATA = "000", "013"


class ServiceError(Exception):
    """A status other than fine."""

    def __init__(self, status: str, message: str):
        super().__init__(f"[{status}] {message}")
        self.status, self.message = status, message


class Client:
    def __init__(self, get: Callable[[str, dict], bytes], key: str, base: str = ""):
        self.get, self.key, self.base = get, key, base

    def _body(self, endpoint: str, params: dict) -> bytes:
        return self.get(self.base + endpoint, {"crtfc_key": self.key} | {k: v for k, v in params.items() if v is not None})

    def json(self, endpoint: str, **params) -> dict:
        out = json.loads(self._body(endpoint, params))
        if out.get("status") != FINE:
            raise ServiceError(out.get("status", "unknown"), out.get("message", ""))
        return out

    def archive(self, endpoint: str, **params) -> bytes:
        """An archive's bytes; anything else is an error in JSON or XML."""
        body = self._body(endpoint, params)
        if body[:2] == b"PK":
            return body
        text = body.decode("utf-8", "replace")
        try:
            found = json.loads(text)
            raise ServiceError(found.get("status", "unknown"), found.get("message", text[:200]))
        except ValueError:
            status, message = (re.search(f"<{t}>(.*?)</{t}>", text) for t in ("status", "message"))
            raise ServiceError(status[1] if status else "unknown", message[1] if message else text[:200]) from None

    def pages(self, endpoint: str, **params) -> Iterator[dict]:
        """Rows of all pages; "no data" ends the listing with what there is."""
        page, last = 1, 1
        while page <= last:
            try:
                out = self.json(endpoint, page_no=page, **params)
            except ServiceError as e:
                if e.status == NO_DATA:
                    return
                raise
            yield from out.get("list", [])
            last, page = int(out.get("total_page", 1)), page + 1


def download(filings: DataFrame, folder: str, client: Callable[[], Client], endpoint: str = "document.xml") -> DataFrame:
    """filings (rcept_no) -> (rcept_no, state, error): the archive of each filing in the shared folder as {rcept_no}.zip.

    What is there already is skipped ("there"), so a run that broke off goes on where it stopped; a filing the service
    refuses is "failed" with the error and the others go on. A file appears under its name only when it is whole.
    `client` is called once in each task; null numbers give no row. The result is lazy: nothing is fetched before it is read."""

    def run(frames):
        import pyarrow.fs

        service = client()
        system, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for f in frames:
            rows = []
            for number in f["rcept_no"]:
                path = f"{root}/{number}.zip"
                if system.get_file_info(path).type == pyarrow.fs.FileType.File:
                    rows.append((number, "there", None))
                    continue
                try:
                    body = service.archive(endpoint, rcept_no=number)
                except (ServiceError, OSError) as e:
                    rows.append((number, "failed", str(e)))
                    continue
                with system.open_output_stream(path + ".part") as out:
                    out.write(body)
                system.move(path + ".part", path)
                rows.append((number, "fetched", None))
            yield pd.DataFrame(rows, columns=["rcept_no", "state", "error"])

    wanted = filings.filter("rcept_no is not null").select(F.col("rcept_no").cast("string").alias("rcept_no")).distinct()
    return wanted.mapInPandas(run, "rcept_no string, state string, error string")


COLUMNS = ("rcept_no", "corp_code", "corp_name", "stock_code", "report_nm", "rcept_dt")


class ListingSource(DataSource):
    """format("filing_listing"): a partition for each company code in option `codes` (comma separated).

    Subclass it with `client()` to reach a service; option names other than codes go to the service as they are."""

    @classmethod
    def name(cls) -> str:
        return "filing_listing"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def client(self) -> Client:
        raise NotImplementedError("subclass ListingSource with a client")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: ListingSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c.strip()) for c in self.source.options["codes"].split(",") if c.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        params = {k: v for k, v in self.source.options.items() if k != "codes"}
        for row in self.source.client().pages("list.json", corp_code=partition.value, **params):
            yield tuple(row.get(c) for c in COLUMNS)
