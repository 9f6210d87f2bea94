"""Lookup tables against values written out here, as the SQL builds its own from the same tables."""

from lodestrata.functions import dims
from lodestrata.operators import hints


def test_families():
    cwes = {
        "xss": "79 80", "sql": "89", "command": "77 78 88", "code_injection": "94 95 1321", "path": "22 23 36", "ssrf": "918", "deserialization": "502",
        "crypto": "326 327 328 338 347 916", "auth": "287 306 862 863 284 285 639 522 521", "redirect": "601", "xxe": "611", "csrf": "352",
        "info_exposure": "200 209 212 532", "dos": "400 770 1333 834 405", "input_validation": "20 74",
    }
    assert {n: " ".join(c.removeprefix("CWE-") for c in f.cwes) for n, f in dims.FAMILIES.items()} == cwes
    assert {n: len(f.markers) for n, f in dims.FAMILIES.items()} == dict(zip(cwes, (7, 9, 8, 8, 7, 7, 6, 10, 8, 4, 7, 4, 8, 7, 3)))
    assert dims.family_by_cwe()["CWE-1321"] == "code_injection" and len(dims.family_by_cwe()) == 43
    assert dims.FAMILIES["sql"].sink == "concatenated into a SQL query" and dims.FAMILIES["xxe"].control == "external entity resolution disabled"


def test_severities():
    levels = list(dims.SEVERITY_BY_CWE.values())
    assert {n: levels.count(n) for n in ("HIGH", "MEDIUM", "LOW")} == {"HIGH": 20, "MEDIUM": 12, "LOW": 1}
    assert [dims.SEVERITY_BY_CWE[f"CWE-{n}"] for n in (78, 416, 326, 1004, 362, 200)] == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "LOW"]
    assert dims.SEVERITY_BY_FAMILY["auth"] == "HIGH" and dims.SEVERITY_BY_FAMILY["xss"] == "MEDIUM" and set(dims.SEVERITY_BY_FAMILY) == set(dims.FAMILIES)


def test_types_and_languages():
    order = "sql_injection command_injection code_injection deserialization xxe xss ssrf path_traversal open_redirect prototype_pollution crypto_weak hardcoded_secret access_control auth"
    assert " ".join(t[0] for t in dims.TAXONOMY) == order
    assert [t[1].removeprefix("CWE-") for t in dims.TAXONOMY] == "89 78 94 502 611 79 918 22 601 1321 327 798 284 287".split()
    assert dims.TYPE_SUBSTRING_CWE["csrf"] == "CWE-352" and len(dims.TYPE_SUBSTRING_CWE) == 12
    assert dims.TYPE_EXACT_CWE["buffer overflow"] == "CWE-120" and len(dims.TYPE_EXACT_CWE) == 17
    assert len(dims.PATCH_EXTENSIONS) == 15 and len(dims.SCAN_EXTENSIONS) == 12
    assert dims.PATCH_EXTENSIONS[".tsx"] == dims.SCAN_EXTENSIONS[".jsx"] == "react" and dims.PATCH_EXTENSIONS[".h"] == "c"
    assert len(dims.STOP_IDENTIFIERS) == len(set(dims.STOP_IDENTIFIERS)) == 44


def test_hint_tables():
    assert [len(t) for t in (hints.PY_TAINT, hints.JS_TAINT, hints.PY_SINKS, hints.JS_SINKS)] == [6, 5, 17, 14]
    assert list(hints.PY_SINKS)[-3:] == ["string_format_sql", "fstring_sql", "shell_concat"] and list(hints.JS_SINKS)[9:13] == ["mongoose_where", "redirect", "template_literal_sql", "require_dynamic"]
