"""Food categories of product names that were read by hand, and a larger lexicon by a shuffle."""

from noticeworks.functions import food as W
from noticeworks.operators import food as O

SAID = {
    "Dark Chocolate Cherry Granola": "pantry_condiments", "Peach Oat Bars": "snacks_sweets", "Butter Flavored Popcorn": "snacks_sweets", "Bacon flavor popcorn seasoning": "pantry_condiments",
    "Dairy-Free Coconut Yogurt, Strawberry flavor": "dairy_eggs", "Popcorn, Butter Flavored": "snacks_sweets", "Sugar Free Chocolate Bars": "snacks_sweets", "Salads containing fresh cucumbers": "prepared_foods",
    "Shortbread Cookies with Apricot Filling": "bakery_grains", "Baby Arugula": "produce", "Baby Back Ribs": "meat_poultry", "Powdered Goat Milk Infant Formula": "baby_food_formula", "Crab Cake 2 Pack": "seafood",
    "Ice Cream Bars": "dairy_eggs", "Raw Bone-In Beef Products": "meat_poultry", "Beef and Chicken Products": "meat_poultry", "Frozen Meat and Poultry Dumpling Products": "prepared_foods", "Macaroni and Cheese": "prepared_foods",
    "Whole Peaches, Plums, and Nectarines": "produce", "Cereal, bars, and snacks": "snacks_sweets|pantry_condiments", "Frozen Waffle and Turkey Sausage Products": "meat_poultry|bakery_grains", "Cheese and Garlic Croutons": "bakery_grains",
    "Fresh cucumbers, salsa and salads": "produce|prepared_foods|pantry_condiments", "Frozen Food Products": "other", "": "other", None: "other", "Metal Cookware Items": "other", "Chocolate Scented Lotion": "other",
    "Jelly Handbag and Jelly Backpack containing Jelly Bars": "snacks_sweets", "Meat Pie Products": "prepared_foods", "Chicken Fried Rice Products": "prepared_foods", "Canned Spaghetti With Sausage Products": "prepared_foods",
    "Apple Pie": "bakery_grains", "Cheese Biscuits": "bakery_grains", "Queso Crunch Salad Kit": "produce", "Jolly Green Apple, Blue Raspberry, Grape Frozen Confection Pop": "snacks_sweets",
    "Iced Tea Lemon, Iced Tea Diet Lemon, Diet Lemonade and Fruit Punch": "beverages", "Pear, Kiwi, Spinach & Pea Baby Food pouches": "baby_food_formula", "Chicken Nuggets": "meat_poultry", "Ground Beef Chubs": "meat_poultry",
    "Plant Based Chicken Nuggets and Hot Sausage Patties": "prepared_foods", "Comforts FOR BABY Purified Water with Fluoride": "baby_food_formula", "Original Sliders, frozen, 4 count carton": "prepared_foods",
    "Multiple items with cucumbers": "produce", "Saimin Noodles with Soup & Garnishes": "pantry_condiments", "Meat and Poultry Frozen Entrée Products": "prepared_foods", "Cookies - Chocolate Chip": "bakery_grains", "Beef Shepherd&rsquo;s Pie": "prepared_foods",
}


def test_names_read_by_hand(spark, monkeypatch):
    df = spark.createDataFrame([(t, 1) for t in SAID], "t string, categories int")
    for most in (O.BROADCAST_TERMS, 3):
        monkeypatch.setattr(O, "BROADCAST_TERMS", most)
        got = {r.key: "|".join(r.categories) for r in O.match(df, "t", "t", W.lexicon(spark)).collect()}
        assert got == SAID


def test_own_lexicon_repeats_and_nothing(spark):
    own = W.lexicon(spark, {"produce": "dragon fruit, fruit", "beverages": "fruit drink mix, mix"})
    df = spark.createDataFrame([(1, "Dragon Fruit"), (1, "Dragon Fruit"), (2, "dragon fruit drink mixes"), (None, "drink")], "key int, text string")
    assert sorted([(r.key, r.categories) for r in O.match(df, "key", "text", own).collect()], key=str) == [(1, ["produce"]), (1, ["produce"]), (2, ["beverages"]), (None, ["other"])]
    assert O.match(df.where("false"), "key", "text", own).collect() == []
    assert sum(len(t.split(",")) for t in W.TERMS.values()) <= 200
