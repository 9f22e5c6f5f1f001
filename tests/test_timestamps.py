from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions.zones import data_version, zone_table
from quillon.operators.timestamps import convert, found, parser_of, with_instants


def us(source, text, zone=None):
    return convert(pa.array([source], pa.string()), pa.array([text], pa.string()), pa.array([zone], pa.string()), data_version()).to_pylist()[0]


def at(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


def test_forms():
    assert us("whatsapp", "[03/02/24, 23:15:10]", "Europe/Berlin") == at(2024, 2, 3, 22, 15, 10)
    assert us("whatsapp", "‎[3/2/2024, 08:00]", "UTC") == at(2024, 2, 3, 8)
    assert us("whatsapp", "2/3/24, 8:05 pm -", "America/New_York") == at(2024, 2, 4, 1, 5)
    assert us("whatsapp", "12/3/24, 12:05 AM -", "UTC") == at(2024, 12, 3, 0, 5)
    assert us("whatsapp", "631547558.247") == us("imessage", "631547558247000000") == 978_307_200_000_000 + 631547558_247000
    assert us("imessage", "633669727") == (978_307_200 + 633669727) * 10**6
    assert us("sms", "1609533345050") == 1609533345050000 and us("mms", "1609886397") == 1609886397000000
    assert us("sms", "20210105T220002Z") == at(2021, 1, 5, 22, 0, 2)
    assert us("sms", "2021-01-16T00:10:44.698136Z") == at(2021, 1, 16, 0, 10, 44) + 698136
    assert us("x", "2021-01-18T13:38:54.328+05:45") == at(2021, 1, 18, 7, 53, 54) + 328000
    assert us("imessage", "2021-03-14 03:14:53 EDT", "America/New_York") == at(2021, 3, 14, 7, 14, 53)
    assert us("imessage", "2021-03-14 03:14:53 CST", "Asia/Shanghai") == at(2021, 3, 13, 19, 14, 53)
    assert us("photo", "2021:01:25 20:27:40.77", "UTC") == at(2021, 1, 25, 20, 27, 40) + 770000
    assert us("photo", "Sun, 20 Jun 2021 10:00:03 -0400") == at(2021, 6, 20, 14, 0, 3)
    assert us("photo", "Jan 21, 2021, 9:04:00 PM UTC") == at(2021, 1, 21, 21, 4)
    assert us("sms", "Mar 27, 2022 2:39:46 AM", "Europe/Berlin") == at(2022, 3, 27, 1, 39, 46)  # skipped reading
    assert us("sms", "Oct 30, 2022 2:30:00 AM", "Europe/Berlin") == at(2022, 10, 30, 0, 30)  # first pass


def test_no_case():
    for text in (None, "", "  ", "null", "n/a", "unknown", "0", "-1", "0.0", "[31/02/24, 10:15:00]", "13/45/22, 10:15 AM -", "2021-13-01T00:00:00Z", "2021-01-01T24:00:00Z", "0000:00:00 00:00:00", "x" * 100_000, "2021-01-01 10:00:00 QQQ"):
        assert us("sms", text, "UTC") is None, text
    assert us("sms", "Mar 27, 2022 2:39:46 AM", None) is None and us("sms", "Mar 27, 2022 2:39:46 AM", "Nowhere/Land") is None
    assert us(None, "1609533345050", None) == 1609533345050000


def test_mask_is_parsed_once():
    assert parser_of("9999-99-99a99:99:99a")["Y"] == (0, 4) and parser_of("aaa") is None


@settings(max_examples=200, deadline=None)
@given(st.integers(-(10**9), 3 * 10**9), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kathmandu", "+05:30"]))
def test_zone_table_agrees_with_zoneinfo(wall, name):
    table = zone_table(name, data_version())
    zone = timezone.utc if name[0] == "+" else ZoneInfo(name)
    naive = datetime.fromtimestamp(wall, timezone.utc).replace(tzinfo=zone, fold=0)
    want = wall - 19800 if name[0] == "+" else int(naive.timestamp())
    assert int(table.to_utc(np.array([wall]))[0]) == want


def test_found_on_tables(spark):
    items = "id string, source string, ts string, export_id string, __zone string, epoch_us string"
    exports = "export_id string, source_tz string, source string"
    e = spark.createDataFrame([("e1", "Europe/Berlin", "z"), ("e2", None, "z"), (None, "UTC", "z")], exports)
    rows = [("a", "SMS", "1609533345050", "e2", "q", "q"), ("a", "SMS", "1609533345050", "e2", "q", "q"), ("b", "whatsapp", "[03/02/24, 23:15:10]", "e1", "q", "q"), ("c", "whatsapp", "[03/02/24, 23:15:10]", "e2", "q", "q"), ("d", None, None, None, None, None), (None, "sms", "1609533345050", "e1", "q", "q"), ("f", "whatsapp", "[03/02/24, 23:15:10]", "none", "q", "q")]
    got = {r.id: r.epoch_us for r in found(spark.createDataFrame(rows, items), e).collect()}
    assert got == {"a": 1609533345050000, "b": at(2024, 2, 3, 22, 15, 10)}
    assert found(spark.createDataFrame([], items), spark.createDataFrame([], exports)).count() == 0
    assert with_instants(spark.createDataFrame(rows, items), e).count() == len(rows)


def test_long_texts_are_read():
    assert us("photo", "September 10, 2020, 10:10:10.123456789012 am +00:00") == at(2020, 9, 10, 10, 10, 10) + 123456
    assert us("sms", " " * 60 + "2021-01-16T00:10:44Z" + "‎" * 60) == at(2021, 1, 16, 0, 10, 44)


def test_tables_travel():
    from quillon.functions import zones

    tables = zones.ZoneTables(["Europe/Berlin", "No/Where", "+02:00"])
    assert set(tables.tables) == {"Europe/Berlin", "+02:00"} and tables.get("No/Where") is None and tables.get("-03:30") is not None
    assert tables.get("Asia/Tokyo") is None  # not among those that were asked for, whatever is installed here
    assert tables.version == zones.ZoneTables(["+02:00", "Europe/Berlin"]).version != zones.ZoneTables(["Asia/Tokyo"]).version
