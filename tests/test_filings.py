"""Filings read in one pass: forms by document order, prefixes, comments, people with roles, broken files."""

import pytest

from sparkfacts.sources import filings


def doc(body, head="", prefix="", attrs=""):
    return f'<?xml version="1.0" encoding="utf-8"?><{prefix}Return returnVersion="2020v4.1"{attrs}><{prefix}ReturnHeader>{head}</{prefix}ReturnHeader><{prefix}ReturnData>{body}</{prefix}ReturnData></{prefix}Return>'


def parsed(spark, *xmls, kind="string"):
    rows = filings.parse_filings(spark.createDataFrame(list(enumerate(xmls)), f"object_id int, xml {kind}")).collect()
    return [r for r in sorted(rows, key=lambda r: r.object_id)]


def test_forms_and_headers(spark):
    both = '<X><IRS990EZ documentId="a"><TotalRevenueAmt>1</TotalRevenueAmt></IRS990EZ></X><IRS990 a="<IRS990EZ>"><CYTotalRevenueAmt>2</CYTotalRevenueAmt></IRS990>'.replace('"<IRS990EZ>"', '"&lt;IRS990EZ&gt;"')
    swapped = '<IRS990 softwareId="7"><CYTotalRevenueAmt>2</CYTotalRevenueAmt><IRS990EZ><TotalRevenueAmt>9</TotalRevenueAmt></IRS990EZ></IRS990><IRS990EZ><TotalRevenueAmt>1</TotalRevenueAmt></IRS990EZ>'
    prefixed = doc("<p:IRS990><p:CYTotalRevenueAmt referenceDocumentId='z'>3</p:CYTotalRevenueAmt></p:IRS990>", "<p:TaxPeriodEndDate> 2019-05-31 </p:TaxPeriodEndDate><p:AmendedReturnInd/><p:Filer><p:EIN>12</p:EIN><p:Name><p:BusinessNameLine1>Å &amp; B</p:BusinessNameLine1></p:Name></p:Filer>", "p:", ' xmlns:p="http://x"')
    a, b, c = parsed(spark, doc(both), doc(swapped), prefixed)
    assert (a.form_type, a.concepts["total_revenue"].value) == ("990EZ", 1)
    assert (b.form_type, b.concepts["total_revenue"].value) == ("990", 2)
    assert (c.form_type, c.concepts["total_revenue"].value, c.tax_period_end, c.fye_month, c.amended, c.ein, c.filer_name, c.return_version) == ("990", 3, "2019-05-31", "05", True, "12", "Å & B", "2020v4.1")
    assert not a.amended and a.fye_month is None


def test_concepts(spark):
    body = """<IRS990>
      <TotalAssetsGrp><BOYAmt>1</BOYAmt><EOYAmt>5</EOYAmt></TotalAssetsGrp><TotalAssetsEOYAmt>n/a</TotalAssetsEOYAmt>
      <CYTotalRevenueAmt></CYTotalRevenueAmt><CYTotalRevenueAmt> 2.5 </CYTotalRevenueAmt><CYTotalRevenueAmt>9</CYTotalRevenueAmt>
      <CYTotalExpensesAmt>12<!-- no -->34</CYTotalExpensesAmt><OccupancyGrp>7<TotalAmt>3.5<X>1</X>8</TotalAmt></OccupancyGrp>
      <FundraisingGrossIncomeAmt>10</FundraisingGrossIncomeAmt><Deep><MembershipDuesAmt>77</MembershipDuesAmt></Deep>
      <CashNonInterestBearingGrp><EOYAmt>1</EOYAmt></CashNonInterestBearingGrp><CashNonInterestBearingGrp><EOYAmt>-4</EOYAmt></CashNonInterestBearingGrp>
      <TotalEmployeeCnt>1e300</TotalEmployeeCnt><OtherRevenueTotalAmt>5</OtherRevenueTotalAmt><GrantsPaid/>
    </IRS990>"""
    (r,) = parsed(spark, doc(body))
    got = {k: (v.status, v.value, v.path) for k, v in r.concepts.items()}
    assert len(got) == 24
    want = {
        "total_assets_eoy": ("resolved", 5, "TotalAssetsGrp/EOYAmt"), "total_revenue": ("resolved", 2, "CYTotalRevenueAmt"), "total_expenses": ("resolved", 12, "CYTotalExpensesAmt"), "occupancy": ("resolved", 4, "OccupancyGrp/TotalAmt"),
        "fundraising_events_net": ("resolved", 10, "FundraisingGrossIncomeAmt - FundraisingDirectExpensesAmt"), "fundraising_events_gross": ("resolved", 10, "FundraisingGrossIncomeAmt"),
        "cash_savings_eoy": ("resolved", -3, "sum(CashNonInterestBearingGrp/EOYAmt) over 2 node(s)"), "membership_dues": ("absent", None, None), "employee_count": ("absent", None, None), "other_revenue": ("absent", None, None),
    }
    assert {k: got[k] for k in want} == want


def test_people(spark):
    full = """<IRS990><Form990PartVIISectionAGrp><PersonNm>A B</PersonNm><TitleTxt>Chair</TitleTxt><AverageHoursPerWeekRt>2.00</AverageHoursPerWeekRt><IndividualTrusteeOrDirectorInd>X</IndividualTrusteeOrDirectorInd><OfficerInd/>
      <ReportableCompFromOrgAmt>100.5</ReportableCompFromOrgAmt><ReportableCompFromRltdOrgAmt>7</ReportableCompFromRltdOrgAmt><OtherCompensationAmt>x</OtherCompensationAmt></Form990PartVIISectionAGrp>
      <Form990PartVIISectionAGrp><NamePerson>C</NamePerson><PersonNm/></Form990PartVIISectionAGrp><Form990PartVIISectionAGrp><TitleTxt>none</TitleTxt></Form990PartVIISectionAGrp>
      <OfficerDirectorTrusteeEmplGrp><PersonNm>Z</PersonNm></OfficerDirectorTrusteeEmplGrp></IRS990>"""
    ez = "<IRS990EZ><OfficerDirectorTrusteeEmplGrp><PersonNm>D</PersonNm><OfficerInd>X</OfficerInd><AverageHrsPerWkDevotedToPosRt>5</AverageHrsPerWkDevotedToPosRt><CompensationAmt>30</CompensationAmt></OfficerDirectorTrusteeEmplGrp></IRS990EZ>"
    a, b = parsed(spark, doc(full), doc(ez))
    assert [tuple(p) for p in a.people] == [
        ("A B", "Chair", 100, "2.00", None, 7, ["individual_trustee_or_director", "officer"]), ("C", None, None, None, None, None, []), (None, "none", None, None, None, None, []),
    ]
    assert [tuple(p) for p in b.people] == [("D", None, 30, "5", None, None, [])]
    assert b.concepts["officer_compensation"].value == 30
    rows = filings.people_rows(filings.parse_filings(spark.createDataFrame([("x", doc(full))], "object_id string, xml string"))).collect()
    assert [(r.pos, r.name) for r in rows] == [(0, "A B"), (1, "C")]


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_broken_files_are_rows_and_stop_nothing(spark, kind):
    good = doc("<IRS990><CYTotalRevenueAmt>1</CYTotalRevenueAmt></IRS990>", "<Filer><EIN>é</EIN></Filer>")
    xmls = [good, good[:-9], "", None, "no xml", "<a><b></a></b>", doc("<IRS990PF/>"), "<a>&unknown;</a>", good.replace('encoding="utf-8"', 'encoding="nonsense"')]
    if kind == "binary":
        xmls = [x if x is None else x.encode() for x in xmls] + [good.replace("utf-8", "iso-8859-1").encode("iso-8859-1"), b"\xff\xfe\x00"]
    frame = spark.createDataFrame(list(enumerate(xmls)), f"object_id int, xml {kind}")
    p = filings.parse_filings(frame)
    bad = {r.object_id: r.reason for r in filings.quarantined(p).collect()}
    want = {1: "malformed", 2: "empty", 3: "empty", 4: "malformed", 5: "malformed", 6: "no_form", 7: "malformed"}
    if kind == "binary":
        want |= {8: "malformed", 10: "malformed"}
        assert {r.object_id: r.ein for r in p.collect()}[9] == "é"
    assert bad == want
    assert {r.object_id for r in filings.concept_rows(p).select("object_id").distinct().collect()} == set(range(len(xmls))) - set(want)


def test_empty_table(spark):
    assert filings.parse_filings(spark.createDataFrame([], "object_id int, xml string")).collect() == []


def test_rows_of_few_documents_at_a_time():
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    n = 2 * filings.SLICE + 1
    batch = pa.RecordBatch.from_pydict({"object_id": pa.array(range(n), "int64"), "xml": [doc("<IRS990/>")] * n})
    out = list(filings._read_batches(iter([batch]), filings._tries(), to_arrow_schema(StructType.fromDDL(f"object_id bigint, {filings.READ}"))))
    assert [b.num_rows for b in out] == [filings.SLICE, filings.SLICE, 1]
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(n))
