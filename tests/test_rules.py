from datetime import date

import pytest

from marketlake.plans import dimensions
from tests.housing_rows import housing


@pytest.fixture(scope="module")
def tables(spark):
    built = dimensions.dimension_tables(housing(spark))
    return {name: {r.property_id: r for r in df.collect()} for name, df in built.items()}


def test_one_row_per_source_row_in_every_dimension(tables):
    assert all(set(rows) == {1, 2, 3, 4, 5, 6, 7} for rows in tables.values())


def test_heating_codes(tables):
    found = [tables["property_details"][i].energy_rating for i in range(1, 8)]
    assert found == ["A", "B", "C", "D", "E", "Non évalué", "Non évalué"]


def test_dates_and_age(tables):
    rows = tables["property_details"]
    assert rows[1].transaction_date == date(2008, 2, 15) and rows[1].listing_date == date(2008, 1, 15)
    # January goes back to the December of the year before.
    assert rows[2].listing_date == date(2006, 12, 15)
    assert rows[3].age_at_sale is None and rows[2].age_at_sale == 31


def test_price_and_area_guard(tables):
    rows = tables["property_details"]
    assert rows[1].price == 7 * 8450.0 * 10 and rows[1].price_per_sqft == 70.0
    assert rows[4].price is None and rows[4].price_per_sqft is None and rows[5].price is None


def test_location(tables):
    rows = tables["location_details"]
    assert rows[1].address == "Propriété 1, NoRidge" and rows[5].address is None
    assert [rows[i].services_proximity for i in (1, 2, 3, 4, 5, 6, 7)] == [
        "Excellent", "Bon", "Limité", "Moyen", "Moyen", "Bon", "Limité"]
    assert rows[1].longitude == pytest.approx(-93.62 + (ord("N") % 10) / 100)
    assert rows[1].latitude == pytest.approx(42.03 + (ord("o") % 10) / 100)
    assert rows[1].street_type is None and rows[3].zoning_code == "RM"


def test_building(tables):
    rows = tables["building_features"]
    assert [rows[i].floor_number for i in range(1, 8)] == [2, 1, 1, 2, 1, 1, 1]
    assert [rows[i].total_floors for i in range(1, 8)] == [2, 1, 2, 3, 2, 1, 1]
    assert [rows[i].garage for i in range(1, 8)] == [True, False, False, False, True, True, True]
    assert [rows[i].pool for i in (1, 2, 3)] == [False, True, False]
    assert [rows[i].garden for i in (2, 3, 4, 5)] == [False, True, False, False]
    assert [rows[i].terrace for i in (1, 2, 3, 4, 5)] == [True, True, False, True, True]
    assert [rows[i].bathrooms for i in (1, 4, 5)] == [2.5, 1.0, 0.0]
    assert [rows[i].cooling_system for i in (1, 2, 3, 4)] == ["Central AC", "None", None, None]
    assert rows[1].parking is False and rows[4].roof_type is None


def test_sale_history(tables):
    rows = tables["sale_history"]
    assert [rows[i].seller_type for i in (1, 2, 3, 4, 5)] == ["Standard", "Constructeur", "Bancaire", "Particulier", "Standard"]
    assert [rows[i].buyer_type for i in range(1, 8)] == [
        "Particulier", "Premier acheteur", "Judiciaire", "Constructeur", "Autre", "Particulier", "Autre"]
    assert rows[5].financing_type == "Comptant" and rows[1].financing_type == "Conventionnel"
    assert rows[1].days_on_market == 100 - 56 + 25 and rows[4].days_on_market is None
    assert rows[1].previous_price == pytest.approx(rows[1].sale_price * 0.9) and rows[1].price_change_percentage == 10.0


def test_absent_columns_get_defaults(spark):
    bare = housing(spark, ("TotRmsAbvGrd", "RoofMatl", "Id", "Neighborhood", "HeatingQC", "YrSold", "SaleType", "OverallCond"))
    building = dimensions.building_features(bare).orderBy("property_id").collect()
    assert sorted(r.total_rooms for r in building) == sorted([7, 6, 7, 5, 4, 4, 6])
    assert {r.roof_type for r in building} == {"Gable", "Hip"}
    assert len({r.property_id for r in building}) == 7
    location = dimensions.location_details(bare).first()
    assert location.address == "Adresse inconnue" and location.longitude == -93.62
    prop = dimensions.property_details(bare).first()
    assert prop.energy_rating == "Non évalué" and prop.listing_date == date(2008, 12, 1) and prop.transaction_date is None
    sale = dimensions.sale_history(bare).first()
    assert sale.days_on_market == 60 and sale.buyer_type == "Particulier" and sale.sale_type is None


def test_mapped_price_column_wins(spark):
    rows = dimensions.property_details(housing(spark), "LotArea").where("property_id = 1").first()
    assert rows.price == 8450.0
