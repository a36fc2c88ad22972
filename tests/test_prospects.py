"""Truth tables of the record rules."""

import pytest
from pyspark.sql import functions as F

from recordweave.functions import evidence, prospects

CASES = [
    ("We are an industrial sensor controller manufacturer.", "", True, ""),
    ("industrial sensor controller manufacturer", "", False, ""),
    ("Industrial automation consulting services.", "", False, "consulting-only"),
    ("SaaS software platform for industrial automation analytics.", "", False, "software-only"),
    ("SEO and digital marketing agency for sensor controller brands.", "", False, "marketing/SEO"),
    ("Recruitment agency hiring sensor and controller engineers.", "", False, "recruitment"),
    ("Technology news publisher covering sensors and embedded controllers.", "", False, "news/media"),
    ("Supplier directory listing industrial sensors and controllers.", "", False, "directory operator"),
    ("Government agency procurement portal for sensors and controllers.", "", False, "government"),
    ("University education blog reviewing medical sensors and controllers.", "", False, "education blog"),
    ("Online fashion store selling sensor and controller themed shirts.", "", False, "unrelated ecommerce"),
    ("Travel tourism affiliate site reviewing sensor gadgets and controllers.", "", False, "travel/tourism"),
    ("PCB manufacturer offering sensor controller PCB assembly.", "", False, "PCB/EMS peer"),
    ("Our sensor controller manufacturer publishes an engineering blog.", "", True, ""),
    ("Government-certified medical sensor and controller device manufacturer.", "", True, ""),
    ("We manufacture industrial sensor and controller products and also provide design consulting.", "", True, ""),
    ("We design medical sensor devices and provide software services.", "", True, ""),
    ("We produce embedded controller equipment with a cloud platform.", "", True, ""),
    ("We are a manufacturer of industrial sensor controllers with software services.", "", True, ""),
    ("Our company handles the production of embedded controller devices with a software platform.", "", True, ""),
    ("Our company handles the sale of industrial sensors and controller devices with software services.", "", True, ""),
    ("We're a software developer that manufactures industrial sensor controllers.", "Acme Controls", False, "software-only"),
    ("Our company is a consulting firm that designs medical sensor devices.", "Acme Controls", False, "consulting-only"),
    ("We operate a cloud platform as our business and manufacture industrial sensors.", "Acme Controls", False, "software-only"),
    ("We manufacture industrial sensor controllers.", "Acme Software Company", False, "software-only"),
]


def test_qualification(spark):
    d = spark.createDataFrame([(i, t, n) for i, (t, n, _, _) in enumerate(CASES)], "i int, t string, n string")
    got = {r.i: r.q for r in d.select("i", evidence.qualification(F.array("t"), F.col("n")).alias("q")).collect()}
    wrong = [(t, got[i]) for i, (t, _, ok, why) in enumerate(CASES) if got[i].eligible != ok or (why and why not in got[i].exclusions)]
    assert not wrong


@pytest.mark.parametrize(("mail", "kind"), [("info@a.example", "Generic Company Email"), ("jo@a.example", "Public Work Email"), ("jo@gmx.de", "Private Email"), ("sales@gmx.de", "Generic Company Email"), ("admin@a.example", None), ("name@example.com", None)])
def test_email_types(spark, mail, kind):
    assert spark.createDataFrame([(mail,)], "e string").select(prospects.email_type(F.col("e"))).first()[0] == kind


def test_a_long_run_costs_one_pass(spark):
    d = spark.createDataFrame([("a" * 400_000 + "@",), ("<a " * 100_000,)], "t string")
    assert [len(r[0]) for r in d.select(prospects.addresses(F.col("t"))).collect()] == [0, 0]
    assert [len(r[0]) for r in d.select(prospects.anchors(F.col("t"), F.lit("https://a.example/"))).collect()] == [0, 0]


def test_known_keys_name_the_domain_of_a_sending(spark, sf):
    from recordweave.plans import catalog

    got = {r.id: r.sent_domain for r in catalog.QUERIES["known_keys"](spark, sf).where("id in (1, 11, 55, 99)").collect()}
    # The company's own domain; the mailbox's where none is named; none if that is free or there is no address.
    assert got == {1: "cust1.example", 11: "cust11.example", 55: "", 99: ""}
