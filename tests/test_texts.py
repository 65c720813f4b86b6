"""Explanations in words and the infrastructure catalogue: examples by hand."""

import pytest
from pyspark.sql import functions as F

from fairvane.operators.explanations import explanation
from fairvane.sources.infrastructure import infrastructure_stations

SCHEMA = (
    "fault string, tier string, station string, t double, p double, h double, t_ok boolean, "
    "reasons array<string>, signal string, health double, days double, alternatives array<string>"
)


def told(spark, *rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(1)
    c, yes = F.col, F.lit(True)
    text = explanation(
        c("fault"), c("tier"), c("station"), {"temperature": c("t"), "pressure": c("p"), "humidity": c("h")},
        {"temperature": c("t_ok"), "pressure": yes, "humidity": yes}, c("reasons"), c("signal"), c("health"), c("days"), c("alternatives"),
    )
    return [r.text for r in df.select(text.alias("text")).collect()]


def test_sound_station_lists_channels(spark):
    out = told(
        spark,
        ("NORMAL", "HIGH", "S", 21.25, 1010.35, 60.0, False, [], "", 99.5, None, []),
        ("NORMAL", None, "S", None, None, None, True, None, None, None, None, None),
    )
    # 21.25 is a tie and goes to even; 1010.35 lies above its tie, as doubles do.
    assert out == [
        "All sensors within normal operating limits (temperature 21.2°C, pressure 1010.4 hPa, humidity 60.0%). Sensor health: 100%.",
        "All sensors within normal operating limits (available channels). Sensor health: unknown%.",
    ]


def test_wording_follows_confidence(spark):
    frozen = [("FROZEN_SENSOR", tier, "S1", 21.5, None, 60.0, True, ["a", "b", "c", "d"], "x", 2.5, None, []) for tier in ("HIGH", "MEDIUM", "LOW", None)]
    out = told(spark, *frozen)
    assert [x.split(" frozen")[0] for x in out] == ["Likely", "Possible", "Potential (low confidence)", "Uncertain"]
    assert [x.split("health: 2%. ")[1].split("Inspect")[0] for x in out] == ["", "If confirmed: ", "Suggested: ", "If it continues: "]
    assert all("Observed: T=21.5°C, RH=60.0%. Evidence: a; b; c. Sensor" in x for x in out)


def test_alternative_and_extrapolation_only_where_there_is_one(spark):
    row = lambda fault, days, alt: (fault, "HIGH", "S", None, None, None, True, ["r"], "", 50.0, days, alt)
    spike, plain, drift, far = told(
        spark, row("SENSOR_SPIKE", 1.0, ["NOISE_BURST", "OTHER"]), row("SENSOR_SPIKE", 1.0, []), row("CALIBRATION_DRIFT", 29.4, []), row("CALIBRATION_DRIFT", 30.0, [])
    )
    assert "Evidence: r. Alternative: NOISE_BURST. Sensor" in spike and "Evidence: r. Sensor" in plain
    assert "some channels have missing data" in spike
    assert "exceeded in about 29 days" in drift and "Rough" not in far


def test_model_reference_is_never_a_hardware_fault(spark):
    (text,) = told(spark, ("MODEL_REFERENCE_INCONSISTENCY", "HIGH", "S", 20.0, None, None, True, [], "sig", 12.0, None, []))
    assert "Sensor health" not in text and "should not be treated as a hardware fault" in text


def test_nulls_and_unknown_faults(spark):
    none = told(
        spark,
        (None, None, None, float("nan"), None, None, True, None, None, None, None, None),
        ("INSUFFICIENT_EVIDENCE", "LOW", "S", 20.0, None, None, None, [], "", 5.0, None, None),
    )
    assert none[0] == "Anomaly at unknown. Observed: some channels have missing data. Evidence: . Sensor health: unknown%."
    assert "Observed: some channels have missing data. Available signal: no specific pattern identified." in none[1]


def catalogue(spark, tmp_path, lines):
    (tmp_path / "part.csv").write_text("\n".join(["extra,device_type,localityId,latitude,longitude,cityName,localityName", *lines]) + "\n")
    known = spark.createDataFrame([("K1",), ("K1",), (None,)], "id string")
    kept, counts = infrastructure_stations(spark, str(tmp_path), known)
    return {r.id: r for r in kept.collect()}, counts.first().asDict()


def test_infrastructure_counts_and_last_row(spark, tmp_path):
    kind = "Automated weather system - v1"
    kept, counts = catalogue(
        spark,
        tmp_path,
        [
            f"1,{kind},A,12.5,77.5,Bengaluru,First",
            f'1,{kind}, A ,12.6,77.6,Bengaluru,"Second, ""North"""',
            "1,Rain gauge system,B,12.5,77.5,Pune,x",
            f"1,{kind},,12.5,77.5,Pune,x",
            f"1,{kind},C,north,77.5,Pune,x",
            f"1,{kind},D,NaN,77.5,Pune,x",
            f"1,{kind},E,38.0,98.0,Jaipur,",
            f"1,{kind},F,38.01,98.0,Jaipur,",
            f"1,{kind},K1,12.5,77.5,Pune,x",
            "1,,,,,,",
        ],
    )
    assert counts == {"added": 3, "skipped_kind": 2, "skipped_invalid": 4, "duplicates": 1}
    assert set(kept) == {"A", "E"}
    assert (kept["A"].latitude, kept["A"].name, kept["A"].town) == (12.6, 'Second, "North" AWS', 'Second, "North", Bengaluru, Karnataka, India')
    assert (kept["E"].name, kept["E"].town) == ("WeatherUnion AWS E", "Jaipur, Jaipur, India")


@pytest.mark.parametrize("lines", [[], ["1,Rain gauge system,B,12.5,77.5,Pune,x"]])
def test_infrastructure_without_stations(spark, tmp_path, lines):
    kept, counts = catalogue(spark, tmp_path, lines)
    assert kept == {} and counts["added"] == 0 and counts["skipped_kind"] == len(lines)
