"""XML filings to concepts with status, value and path; the concept map is data."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Concept, then for each form its candidate paths in order, or sum of paths, or a minus b, or None (not on the form).
CONCEPTS = (
    ("total_revenue", ("CYTotalRevenueAmt",), ("TotalRevenueAmt",)),
    ("total_expenses", ("CYTotalExpensesAmt",), ("TotalExpensesAmt",)),
    ("revenue_less_expenses", ("CYRevenuesLessExpensesAmt",), ("ExcessOrDeficitForYearAmt",)),
    ("contributions_grants", ("CYContributionsGrantsAmt",), ("ContributionsGiftsGrantsEtcAmt",)),
    ("program_service_revenue", ("CYProgramServiceRevenueAmt",), ("ProgramServiceRevenueAmt",)),
    ("membership_dues", ("MembershipDuesAmt",), ("MembershipDuesAmt",)),
    ("investment_income", ("CYInvestmentIncomeAmt",), ("InvestmentIncomeAmt",)),
    ("fundraising_events_gross", ("FundraisingGrossIncomeAmt", "GrossIncomeFundraisingEventsAmt"), ("FundraisingGrossIncomeAmt",)),
    ("fundraising_events_net", {"sub": ("FundraisingGrossIncomeAmt", "FundraisingDirectExpensesAmt")}, ("SpecialEventsNetIncomeLossAmt",)),
    ("other_revenue", ("CYOtherRevenueAmt",), ("OtherRevenueTotalAmt",)),
    ("grants_paid", ("CYGrantsAndSimilarPaidAmt",), ("GrantsAndSimilarAmountsPaidAmt",)),
    ("salaries_benefits_total", ("CYSalariesCompEmpBnftPaidAmt",), ("SalariesOtherCompEmplBnftAmt",)),
    ("officer_compensation", ("CompCurrentOfcrDirectorsGrp/TotalAmt", "CompCurrentOfcrDirectorsAmt"), {"sum": ("OfficerDirectorTrusteeEmplGrp/CompensationAmt",)}),
    ("professional_fundraising_fees", ("FeesForServicesProfFundraisingGrp/TotalAmt", "FeesForServicesProfFundraising"), None),
    ("occupancy", ("OccupancyGrp/TotalAmt",), ("OccupancyRentUtltsAndMaintAmt",)),
    ("program_service_expense", ("TotalFunctionalExpensesGrp/ProgramServicesAmt",), ("TotalProgramServiceExpensesAmt",)),
    ("management_general_expense", ("TotalFunctionalExpensesGrp/ManagementAndGeneralAmt",), None),
    ("fundraising_expense", ("TotalFunctionalExpensesGrp/FundraisingAmt",), None),
    ("total_assets_eoy", ("TotalAssetsEOYAmt", "TotalAssetsGrp/EOYAmt"), ("Form990TotalAssetsGrp/EOYAmt",)),
    ("total_liabilities_eoy", ("TotalLiabilitiesEOYAmt", "TotalLiabilitiesGrp/EOYAmt"), ("SumOfTotalLiabilitiesGrp/EOYAmt",)),
    ("net_assets_eoy", ("TotalNetAssetsFundBalanceGrp/EOYAmt", "NetAssetsOrFundBalancesEOYAmt"), ("NetAssetsOrFundBalancesEOYAmt", "NetAssetsOrFundBalancesGrp/EOYAmt")),
    ("cash_savings_eoy", {"sum": ("CashNonInterestBearingGrp/EOYAmt", "SavingsAndTempCashInvstGrp/EOYAmt")}, ("CashSavingsAndInvestmentsGrp/EOYAmt",)),
    ("land_buildings_equipment_net", ("LandBldgEquipBasisNetGrp/EOYAmt",), ("LandAndBuildingsGrp/EOYAmt",)),
    ("employee_count", ("TotalEmployeeCnt",), None),
)
FORMS = {"990": "IRS990", "990EZ": "IRS990EZ"}
# Paths below the header, for each field the candidates in order.
HEADER = {
    "tax_period_end": ("TaxPeriodEndDt", "TaxPeriodEndDate"),
    "tax_period_begin": ("TaxPeriodBeginDt", "TaxPeriodBeginDate"),
    "ein": ("Filer/EIN",),
    "filer_name": ("Filer/BusinessName/BusinessNameLine1Txt", "Filer/Name/BusinessNameLine1"),
    "return_type": ("ReturnTypeCd",),
}
AMENDED = "AmendedReturnInd"
# Group of a person on each form, and below it name (two candidates), title, hours and amounts; check boxes of the full form, checked by being there.
PEOPLE = {
    "IRS990": ("Form990PartVIISectionAGrp", {"name": ("PersonNm", "NamePerson"), "title": ("TitleTxt",), "avg_hours": ("AverageHoursPerWeekRt",), "comp": ("ReportableCompFromOrgAmt",), "other_comp": ("OtherCompensationAmt",), "related_org_comp": ("ReportableCompFromRltdOrgAmt",)}),
    "IRS990EZ": ("OfficerDirectorTrusteeEmplGrp", {"name": ("PersonNm", "NamePerson"), "title": ("TitleTxt",), "avg_hours": ("AverageHrsPerWkDevotedToPosRt",), "comp": ("CompensationAmt",)}),
}
ROLES = {
    "IndividualTrusteeOrDirectorInd": "individual_trustee_or_director",
    "OfficerInd": "officer",
    "KeyEmployeeInd": "key_employee",
    "HighestCompensatedEmployeeInd": "highest_compensated_employee",
    "FormerOfcrDirectorTrusteeInd": "former_officer_director_trustee",
}
PERSON = "struct<name:string,title:string,comp:bigint,avg_hours:string,other_comp:bigint,related_org_comp:bigint,role_flags:array<string>>"


def _paths(spec) -> tuple[str, ...]:
    return () if spec is None else next(iter(spec.values())) if isinstance(spec, dict) else spec


def _trie(paths) -> dict:
    """Nested dicts by element; the key None holds the path that ends there."""
    top: dict = {}
    for path in paths:
        at = top
        for name in path.split("/"):
            at = at.setdefault(name, {})
        at[None] = path
    return top


def _tries() -> dict[str, dict]:
    """What is read below the header and below each form."""
    out = {"ReturnHeader": _trie([AMENDED, *(p for c in HEADER.values() for p in c)])}
    for i, form in enumerate(FORMS.values()):
        group, fields = PEOPLE[form]
        below = [*(p for c in fields.values() for p in c), *(ROLES if form == "IRS990" else ())]
        out[form] = _trie([*(p for c in CONCEPTS for p in _paths(c[1 + i])), group, *(f"{group}/{p}" for p in below)])
    return out


def whole_number(text: str | None) -> int | None:
    """A number rounded half to even, or None; so are numbers beyond 64 bits."""
    try:
        value = round(float(text))
    except (TypeError, ValueError, OverflowError):
        return None
    return value if -(1 << 63) <= value < 1 << 63 else None


class Walk:
    """One pass over a document's parse events; text counts up to an element's first child or comment.

    Prefixes of names and attributes are ignored, but for the root's returnVersion. The
    form is the first form element met, at any depth; headers count at any depth.
    """

    def __init__(self, tries: dict[str, dict]):
        self.tries, self.stack, self.version, self.form, self.path = tries, [], None, None, None
        self.header: dict[str, str] = {}
        self.values: dict[str, list[str]] = {}
        self.people: list[dict[str, str]] = []
        self.text: list[str] = []

    def read(self, xml: str | bytes) -> None:
        parser = expat.ParserCreate("UTF-8" if isinstance(xml, str) else None)
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.chars
        parser.CommentHandler = lambda _: self.close()
        parser.Parse(xml, True)

    def start(self, name: str, attributes: dict) -> None:
        self.close()
        name = name.rpartition(":")[2]
        if not self.stack:
            self.version = attributes.get("returnVersion")
        where, node = self.stack[-1] if self.stack else (None, None)
        node = node.get(name) if node else None
        if node is None and (name == "ReturnHeader" or name in self.tries and self.form is None):
            where, node = name, self.tries[name]
            self.form = self.form if name == "ReturnHeader" else name
        elif node and None in node:
            self.path = (where, node[None])
            if where != "ReturnHeader" and node[None] == PEOPLE[where][0]:
                self.people.append({})
        self.stack.append((where, node))

    def chars(self, text: str) -> None:
        if self.path:
            self.text.append(text)

    def end(self, _: str) -> None:
        self.close()
        self.stack.pop()

    def close(self) -> None:
        if not self.path:
            return
        (where, path), text = self.path, "".join(self.text).strip()
        self.path, self.text = None, []
        if where == "ReturnHeader":
            self.header.setdefault(path, text)
            return
        self.values.setdefault(path, []).append(text)
        group, _, field = path.rpartition("/")
        if group == PEOPLE[where][0]:
            self.people[-1].setdefault(field, text)


def _person(form: str, found: dict[str, str]) -> dict:
    fields = PEOPLE[form][1]
    text = {k: next((found[p] for p in paths if found.get(p)), found.get(paths[-1])) for k, paths in fields.items()}
    return {k: whole_number(text.get(k)) if "comp" in k else text.get(k) for k in ("name", "title", "comp", "avg_hours", "other_comp", "related_org_comp")} | {"role_flags": [flag for tag, flag in ROLES.items() if form == "IRS990" and tag in found]}


def _read(xml: str | bytes | None, tries: dict[str, dict]) -> dict:
    """One document as a row of READ; ``error`` says why it can't be used."""
    if not xml:
        return {"error": "empty"}
    walk = Walk(tries)
    try:
        walk.read(xml)
    except (expat.ExpatError, UnicodeError, LookupError, ValueError) as e:
        return {"error": f"malformed: {e}"}
    header = {k: next((walk.header[p] for p in paths if walk.header.get(p)), None) for k, paths in HEADER.items()}
    header |= {"return_version": walk.version, "amended": AMENDED in walk.header}
    if walk.form is None:
        return header | {"error": "no_form"}
    numbers = {p: own for p, texts in walk.values.items() if (own := [v for t in texts if (v := whole_number(t)) is not None])}
    return header | {"form_type": {v: k for k, v in FORMS.items()}[walk.form], "numbers": list(numbers.items()), "people": [_person(walk.form, p) for p in walk.people]}


READ = f"form_type string, return_version string, tax_period_end string, tax_period_begin string, ein string, filer_name string, amended boolean, return_type string, numbers map<string,array<bigint>>, people array<{PERSON}>, error string"


#: Documents whose rows a task holds at a time.
SLICE = 256


def _read_batches(batches, tries: dict[str, dict], arrow: pa.Schema):
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            ids, xmls = batch.slice(start, SLICE).columns
            yield pa.RecordBatch.from_pylist([{"object_id": i, **_read(xml.as_py(), tries)} for i, xml in zip(ids.to_pylist(), xmls)], arrow)


def read_filings(files: DataFrame) -> DataFrame:
    """Rows of (object_id, xml), read once each: header, form, numbers by path, people, or an error.

    Nothing stops the job: null, malformed and formless documents are rows with ``error``.
    A task holds the rows of SLICE documents, whatever the size of its batches.
    """
    schema = f"object_id {files.schema['object_id'].dataType.simpleString()}, {READ}"
    tries, arrow = _tries(), to_arrow_schema(StructType.fromDDL(schema))
    return files.select("object_id", "xml").mapInArrow(lambda batches: _read_batches(batches, tries, arrow), schema)


def _numbers(path: str) -> Column:
    return F.coalesce(F.col("numbers")[path], F.array().cast("array<bigint>"))


def _concept(spec) -> Column:
    """struct(status, value, path) of one concept on one form."""
    if spec is None:
        return F.struct(F.lit("not_on_form").alias("status"), F.lit(None).cast("long").alias("value"), F.lit(None).cast("string").alias("path"))
    if isinstance(spec, dict) and "sum" in spec:
        nodes = F.flatten(F.array(*(_numbers(p) for p in spec["sum"])))
        value = F.when(F.size(nodes) > 0, F.aggregate(nodes, F.lit(0).cast("long"), lambda a, x: a + x))
        used = F.concat_ws(" + ", *(F.when(F.size(_numbers(p)) > 0, F.lit(p)) for p in spec["sum"]))
        path = F.concat(F.lit("sum("), used, F.lit(") over "), F.size(nodes).cast("string"), F.lit(" node(s)"))
    elif isinstance(spec, dict):
        a, b = (F.get(_numbers(p), F.lit(0)) for p in spec["sub"])
        value, path = a - F.coalesce(b, F.lit(0)), F.lit(" - ".join(spec["sub"]))
    else:
        firsts = [F.get(_numbers(p), F.lit(0)) for p in spec]
        value = F.coalesce(*firsts)
        path = F.coalesce(*(F.when(v.isNotNull(), F.lit(p)) for v, p in zip(firsts, spec)))
    return F.struct(F.when(value.isNull(), "absent").otherwise("resolved").alias("status"), value.alias("value"), F.when(value.isNotNull(), path).alias("path"))


def parse_filings(files: DataFrame) -> DataFrame:
    """Rows of (object_id, xml) with header fields, form, people and a map of concepts.

    ``form_type`` is null and ``error`` says why where a document can't be used:
    ``quarantined`` gives these rows.
    """
    df = read_filings(files)
    maps = {f: F.create_map(*(x for c in CONCEPTS for x in (F.lit(c[0]), _concept(c[1 + i])))) for i, f in enumerate(FORMS)}
    concepts = F.when(F.col("form_type") == "990", maps["990"]).when(F.col("form_type") == "990EZ", maps["990EZ"])
    return df.withColumn("fye_month", F.substring("tax_period_end", 6, 2)).withColumn("concepts", concepts).drop("numbers")


def quarantined(parsed: DataFrame) -> DataFrame:
    """(object_id, reason, detail) of documents that can't be used."""
    return parsed.filter("error is not null").select("object_id", F.split("error", ": ", 2)[0].alias("reason"), F.col("error").alias("detail"))


def concept_rows(parsed: DataFrame) -> DataFrame:
    """(object_id, form_type, concept, status, value, path), one row a concept."""
    return parsed.filter("form_type is not null").select("object_id", "form_type", F.explode("concepts").alias("concept", "c")).select("object_id", "form_type", "concept", "c.*")


def people_rows(parsed: DataFrame) -> DataFrame:
    """(object_id, pos, name, title, comp, avg_hours, other_comp, related_org_comp, role_flags) of people with a name."""
    return parsed.select("object_id", F.posexplode("people").alias("pos", "p")).select("object_id", "pos", "p.*").filter("name <> ''")
