"""Files, the service client, markup and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from filedeck.sources import files, markup
from filedeck.sources.client import Client, ListingSource, ServiceError, download
from filedeck.streaming import loading


def test_csv_and_xml(spark, tmp_path):
    (tmp_path / "c.csv").write_text("corp_code,corp_name,stock_code,modify_date\n00126380,삼,005930,20240101\n00000001,나,,\n")
    assert [tuple(r) for r in files.strings_csv(spark, str(tmp_path / "c.csv"), files.ENTITY).orderBy("corp_code").collect()] == [("00000001", "나", "", ""), ("00126380", "삼", "005930", "20240101")]
    (tmp_path / "c.xml").write_text("<result><list><corp_code>00126380</corp_code><corp_name> 삼 </corp_name><stock_code>005930</stock_code><modify_date>20240101</modify_date></list><list><corp_code>00000001</corp_code><corp_name>나</corp_name><stock_code> </stock_code><modify_date>20230101</modify_date></list></result>")
    assert [tuple(r) for r in files.entities_xml(spark, str(tmp_path / "c.xml")).orderBy("corp_code").collect()] == [("00000001", "나", "", "20230101"), ("00126380", "삼", "005930", "20240101")]


def test_json(spark, tmp_path):
    row = {"rcept_no": "1", "corp_code": "00000001", "report_nm": "사업보고서", "rcept_dt": "20240315"}
    (tmp_path / "a.json").write_text(json.dumps({"status": "000", "message": "ok", "list": [row, row | {"rcept_no": "2", "rcept_dt": "x"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"status": "013", "message": "no data"}))
    (tmp_path / "c.json").write_text(json.dumps({"status": "020", "message": "limit"}))
    assert [(r["rcept_no"], str(r["rcept_dt"])) for r in files.listing_pages(spark, str(tmp_path)).orderBy("rcept_no").collect()] == [("1", "2024-03-15"), ("2", "None")]
    assert [tuple(r) for r in files.page_errors(spark, str(tmp_path)).collect()] == [("020", "limit")]


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("b.xml", "둘".encode("euc-kr"))
        z.writestr("a.xml", "하나 ✓".encode())
    (tmp_path / "1.zip").write_bytes(buffer.getvalue())
    (tmp_path / "2.zip").write_bytes(b"<status>014</status>")
    found = files.archives(spark, str(tmp_path)).orderBy("path", "part_no").collect()
    assert [(r["part"], r["text"], r["error"] is None) for r in found] == [("a.xml", "하나 ✓", True), ("b.xml", "둘", True), (None, None, False)]
    content = spark.read.format("binaryFile").load(str(tmp_path)).orderBy("path").select(files.is_zip(F.col("content")))
    assert [r[0] for r in content.collect()] == [True, False]


class Fake:
    def __init__(self, *bodies):
        self.bodies, self.asked = list(bodies), []

    def __call__(self, url, params):
        self.asked.append(params)
        body = self.bodies.pop(0)
        return body if isinstance(body, bytes) else json.dumps(body).encode()


def test_client():
    fake = Fake({"status": "000", "total_page": 2, "list": [{"a": 1}]}, {"status": "000", "total_page": 2, "list": [{"a": 2}]})
    assert list(Client(fake, "k").pages("list.json", corp_code="1", end_de=None)) == [{"a": 1}, {"a": 2}]
    assert fake.asked[1] == {"crtfc_key": "k", "page_no": 2, "corp_code": "1"}
    assert list(Client(Fake({"status": "013", "message": "none"}), "k").pages("x")) == []
    with pytest.raises(ServiceError, match="020"):
        list(Client(Fake({"status": "020", "message": "limit"}), "k").pages("x"))
    assert Client(Fake(b"PK\x03"), "k").archive("x") == b"PK\x03"
    for body, status in ((b'{"status": "013", "message": "m"}', "013"), (b"<r><status>014</status><message>m</message></r>", "014"), (b"oops", "unknown")):
        with pytest.raises(ServiceError) as e:
            Client(Fake(body), "k").archive("x")
        assert e.value.status == status


def test_listing_source(spark):
    class Offline(ListingSource):
        @classmethod
        def name(cls):
            return "offline_listing"

        def client(self):
            def get(url, params):
                return json.dumps({"status": "000", "total_page": 1, "list": [{"rcept_no": params["corp_code"] + "1", "corp_code": params["corp_code"]}]}).encode()

            return Client(get, "k")

    spark.dataSource.register(Offline)
    found = spark.read.format("offline_listing").option("codes", "1,2").load()
    assert sorted((r["rcept_no"], r["report_nm"]) for r in found.collect()) == [("11", None), ("21", None)]


REPORT = """<DOCUMENT><SECTION-1><TITLE>Ⅱ.<SPAN> 사업 </SPAN>개요</TITLE><TITLE>둘째 제목</TITLE>bare<P>첫 문단 <SPAN>둘</SPAN></P><P> </P>
<SECTION-2><TITLE> </TITLE><TITLE>안 쓰임</TITLE><TABLE-GROUP><TABLE><TR><TD>품목</TD><TH>수량</TH></TR><TR><TU>밸브</TU><TE>17</TE></TR><TR><TD></TD></TR></TABLE></TABLE-GROUP></SECTION-2>
<TABLE><TBODY><TR><TD>공장<TABLE><TR><TD>서부</TD><TD>41</TD></TR><TR><TD>남부</TD><TD>9</TD></TR></TABLE> 현황<TABLE><TR><TD>북부</TD></TR></TABLE></TD><TD><TABLE></TABLE></TD></TR><TR><TD>모두</TD><TD>50</TD></TR></TBODY></TABLE>
<table><TR><TD>x</TD></TR></table></SECTION-1><P>끝 A & B <가짜></P></DOCUMENT>"""


def test_markup(spark):
    df = spark.createDataFrame([("1", REPORT), ("2", "<P>broken"), ("3", None), ("4", "")], "id string, x string")
    found = markup.parsed(df, F.col("id"), F.col("x")).orderBy("doc", "ordinal").collect()
    assert [(r["section_path"], r["type"], r["text"]) for r in found if r["doc"] == "1"] == [
        (["Ⅱ.사업개요"], "paragraph", "첫 문단 둘"),
        (["Ⅱ.사업개요"], "table", "품목 | 수량\n밸브 | 17"),
        (["Ⅱ.사업개요"], "table", "공장 현황 [서부 | 41; 남부 | 9] / [북부] | []\n모두 | 50"),
        ([], "paragraph", "끝 A & B <가짜>"),
    ]
    assert [(r["doc"], r["ordinal"], r["text"]) for r in found if r["doc"] != "1"] == [("2", 0, "broken")]
    assert markup.whole_text(markup.parsed(df, F.col("id"), F.col("x")).filter("doc = '1'")).first()["text"].startswith("첫 문단 둘\n\n품목 | 수량")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("<SECTION-1><TITLE>가</TITLE><P>하나<P>둘</SECTION-1><P>셋</P>", [(["가"], "paragraph", "하나 둘"), ([], "paragraph", "셋")]),
        ("<P>하나</B></P></SECTION-1><P>둘</P>", [([], "paragraph", "하나"), ([], "paragraph", "둘")]),
        ("<TABLE><TR><TD>가<TD>나</TR></TABLE><P>다", [([], "table", "가 나"), ([], "paragraph", "다")]),
        ("<P a=b>x &amp; y</P><!-- <P>no</P> --><IMG SRC=1/><P>z</P>", [([], "paragraph", "x & y"), ([], "paragraph", "z")]),
        ("no markup at all", []),
    ],
)
def test_broken_markup(text, expected):
    assert markup.blocks(text) == expected


def test_broken_markup_in_linear_time():
    assert len(markup.blocks("<P>a</B></P>" * 20_000)) == 20_000


def test_filing_of_several_parts(spark):
    df = spark.createDataFrame([("z", 1, "<P>셋</P>"), ("z", 0, "<P>하나</P><P>둘</P>"), ("y", 0, "<P>넷"), ("y", 1, None)], "path string, part_no int, text string").withColumn("doc", F.lit(1))
    found = markup.filing_blocks(df)
    assert sorted((r["doc"], r["ordinal"], r["text"]) for r in found.collect()) == [("y", 0, "넷"), ("z", 0, "하나"), ("z", 1, "둘"), ("z", 2, "셋")]
    assert {r["doc"]: r["text"] for r in markup.whole_text(found).collect()} == {"y": "넷", "z": "하나\n\n둘\n\n셋"}


def test_download(spark, tmp_path):
    """A run that broke off goes on; a refused filing does not stop the others."""

    def client():
        def get(url, params):
            return b'{"status": "014", "message": "no file"}' if params["rcept_no"] == "2" else b"PK" + params["rcept_no"].encode()

        return Client(get, "k")

    df = spark.createDataFrame([("1",), ("2",), ("3",), ("3",), (None,)], "rcept_no string")
    (tmp_path / "3.zip").write_bytes(b"PKold")
    found = sorted((r["rcept_no"], r["state"], r["error"]) for r in download(df, str(tmp_path), client).collect())
    assert found == [("1", "fetched", None), ("2", "failed", "[014] no file"), ("3", "there", None)]
    assert (tmp_path / "1.zip").read_bytes() == b"PK1" and (tmp_path / "3.zip").read_bytes() == b"PKold" and not (tmp_path / "2.zip").exists()
    assert sorted(r["state"] for r in download(df, str(tmp_path), client).collect()) == ["failed", "there", "there"]


def test_markup_round_trip(spark, sf):
    df = spark.read.parquet(f"{sf}/chunks.parquet").filter("lower(trim(chunk_type)) = 'table' and text not like '%<%'")
    back = markup.parsed(df, F.col("id"), markup.as_markup(F.col("section_path"), F.lit("table"), F.col("text")))
    joined = back.join(df.select(F.col("id").cast("string").alias("doc"), F.col("text").alias("before"), F.col("section_path").alias("path")), "doc").collect()
    squeeze = lambda t: "\n".join(" | ".join(c.strip() for c in r.split(" | ")) for r in t.split("\n") if r.strip())
    assert joined and all(r["section_path"] == r["path"] and r["text"] == squeeze(r["before"]) for r in joined)


def test_stream_loads_once(spark, tmp_path):
    schema = "id bigint, rcept_no string, section_path array<string>, chunk_index int, text string"
    landed, target = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.createDataFrame([(1, "r", ["a"], 0, "x"), (2, "r", ["a"], 0, "again"), (3, "r", ["a"], 1, "y")], schema)
    first.write.parquet(landed)
    for _ in range(2):
        loading.load(loading.stream(spark, landed, schema), target, str(tmp_path / "mark")).awaitTermination(120)
    spark.createDataFrame([(4, "r", ["a"], 1, "late"), (5, "s", [], 0, "z")], schema).write.mode("append").parquet(landed)
    loading.load(loading.stream(spark, landed, schema), target, str(tmp_path / "mark")).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 3, 5]
    loading.append_new(target)(first, 9)  # a batch that is run again
    assert spark.read.parquet(target).count() == 3


def test_stream_versions(spark, sf, tmp_path):
    filings = spark.read.parquet(f"{sf}/filings.parquet")
    filings.write.parquet(str(tmp_path / "in"))
    running = loading.current_versions(loading.stream(spark, str(tmp_path / "in"), filings.schema).select("rcept_no", "corp_code", "loaded_at"))
    q = running.writeStream.outputMode("complete").format("memory").queryName("versions").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("versions").count() == filings.select("rcept_no").distinct().count()


def test_save(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for kind in ("parquet", "csv", "json"):
        files.save(df, str(tmp_path / kind), kind)
        files.save(df, str(tmp_path / kind), kind)
    files.save(df, str(tmp_path / "by"), by=["k"])
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and (tmp_path / "by" / "k=a").exists()
