"""Illness statuses of sentences that were read by hand."""

from pyspark.sql import functions as F

from noticeworks.functions import illness

N, U, Q = "explicit_none", "unknown", "reported_unspecified"
#: text: illness count or kind, hospitalisations, deaths (a count, or a kind)
SAID = {
    "Four (4) illnesses have been reported to date.": (4, U, U),
    "This is an ongoing outbreak, and several illnesses have been reported to the Centers for Disease Control.": (Q, U, U),
    "No illnesses have been reported to date.": (N, U, U),
    "The product was distributed to retail stores in Ohio.": (U, U, U),
    "": (U, U, U),
    "Consumption of food contaminated with Salmonella can cause salmonellosis, a common illness. Older adults are more likely to develop a severe illness.": (U, U, U),
    "Anyone concerned about an illness should contact a healthcare provider.": (U, U, U),
    "The problem was discovered during FSIS surveillance activities.": (U, U, U),
    "No injuries have been reported to date.": (U, U, U),
    "There have been no confirmed reports of adverse reactions due to consumption of these products.": (U, U, U),
    "No deaths have been reported to date.": (U, U, U),
    "One customer reported an allergic reaction to milk, which is how the firm became aware of it.": (U, U, U),
    "One hospitalization due to Listeria monocytogenes has been reported to date.": (U, 1, U),
    "No illnesses or injuries have been reported to date.": (N, U, U),
    "At this time, no confirmed allergic reactions or illnesses have been reported related to this issue.": (N, U, U),
    "To date, VidaSlim has not received reports of illnesses related to the consumption of this product.": (N, U, U),
    "To date, Elevation Foods is not aware of any reports of consumer illness related to this product.": (N, U, U),
    "Neither FSIS nor the company received any reports of illnesses associated with this product.": (N, U, U),
    "One consumer illness has been reported to date.": (1, U, U),
    "It has been reported that there have been 92 instances of illness in connection with this problem.": (92, U, U),
    "To date, 55 reports of illnesses have been received by federal and state partners.": (55, U, U),
    "The company was notified by the CDC of 12 recorded illnesses linked to the walnuts.": (12, U, U),
    "Three Salmonella case-patients have been identified.": (3, U, U),
    "To date, two cases of illness have been reported in this outbreak.": (2, U, U),
    "To date, approximately 12 illnesses have been reported.": (12, U, U),
    "To date, the company has received approximately 470 reports of illness or adverse reactions.": (U, U, U),
    "Illnesses have been reported; the number and extent of which are under investigation.": (Q, U, U),
    "Three illnesses were reported in June. Nine illnesses were reported in July.": (Q, U, U),
    "As of July 25, 2024, sick people have been identified in 13 states.": (Q, U, U),
    "The recall covers 120 cases of product distributed to 27 states.": (U, U, U),
    "There have been 20 reported cases in six (6) states with onset dates between July 24, 2022 and September 19, 2022 with 5 hospitalization and no deaths.": (U, 5, U),
    "To date, there have been 9 illnesses, 8 hospitalizations, and 1 death linked to the soft cheese products.": (9, 8, 1),
    "FSIS has received no additional reports of injury or illness from consumption of these products.": (U, U, U),
    "The firm reported 9 illnesses. No additional illnesses have been reported.": (9, U, U),
    "The company has received reports of illness associated with this product.": (Q, U, U),
    "Its supplier said that the cucumbers were associated with reported salmonellosis illnesses. To date, no illnesses have been reported for the recalled slices.": (N, U, U),
    "The slices may contain recalled cucumbers supplied by SunFed, which were associated with reported salmonellosis illnesses.": (U, U, U),
    "The supplier may be associated with reported salmonellosis illnesses.": (U, U, U),
    "All 5 case-patients consumed beef products supplied by Adams Farms.": (5, U, U),
    "The FDA has not identified a direct link between any formula and these cases. A total of 13 cases of infant botulism were reported.": (U, U, U),
    "A total of 31 infants with suspected infant botulism and confirmed exposure to the formula have been reported from 15 states.": (Q, U, U),
    "An estimated 83 cases of infant botulism were reported nationwide since August 2025.": (U, U, U),
    "The company provided information about 3 cases of infant botulism in infants who had consumed the formula.": (3, U, U),
    "For 27 cases with illness onset information available, illnesses started in August.": (U, U, U),
    "Complications can include brain abscess and death.": (U, U, U),
    "In some persons the diarrhea may be so severe that the patient needs to be hospitalized.": (U, U, U),
    "Thoroughly cooking product does not prevent illness.": (U, U, U),
    "Seven illnesses were reported and 2 case-patients were hospitalized.": (7, 2, U),
}


def test_statuses_read_by_hand(spark):
    df = spark.createDataFrame([(t, t) for t in SAID] + [("null", None)], "kind string, text string")
    got = {r.key: r for r in illness.illness_status(df, "kind", "text").collect()}
    fact = lambda h: h["count"] if h["kind"] == "reported_count" else h["kind"]
    said = {t: (r.illnesses if r.kind == "reported_count" else r.kind, fact(r.hospitalizations), fact(r.deaths)) for t, r in got.items()}
    assert {t: (said[t], w) for t, w in SAID.items() if said[t] != w} == {} and said["null"] == (U, U, U)
    assert got["To date, approximately 12 illnesses have been reported."].approximate
    assert not got["The company provided information about 3 cases of infant botulism in infants who had consumed the formula."].approximate
    assert got["Three illnesses were reported in June. Nine illnesses were reported in July."].statements == ["Three illnesses were reported in June.", "Nine illnesses were reported in July."]


def test_reports_read_by_hand(spark):
    said = {
        "Four illnesses have been reported to date.": "reported", "No illnesses have been reported to date.": "none_reported", "Salmonella can make people ill.": "unknown", None: "unknown",
        "There have been no confirmed reports of adverse reactions. One customer reported an allergic reaction to milk.": "reported", "The FDA continues to receive adverse event reports.": "reported",
        "A total of 345 people infected with the outbreak strain have been reported from 27 states.": "reported", "The issue was discovered when a consumer reported illness.": "unknown",
    }
    df = spark.createDataFrame([(t,) for t in said], "t string")
    got = [r[0] for r in df.select(illness.illness_report(F.col("t"))).collect()]
    assert [g.status for g in got] == list(said.values()) and len(got[0].statements) == 1 and got[3].statements == []
