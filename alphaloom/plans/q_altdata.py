"""Registered queries: retail alternative-data signals."""

from __future__ import annotations


from ..operators import altdata as ad
from ..operators.normalize import global_minmax
from ..sources import fixtures as fx
from .registry import register


def signals(spark, base) -> ad.Signals:
    return ad.Signals(fx.retail_transactions(spark, base))


def _grain(spark, base):
    return ad.grain(fx.retail_transactions(spark, base))


@register("daily_product_items", "DateOnly, Product, Daily_Items",
          "FROM daily_prod", ctes=("daily_prod",))
def q_daily_product_items(spark, base):
    return ad.daily_product_items(_grain(spark, base))


@register("demand_momentum", "DateOnly, Product, Daily_Items, Items_7d, Items_30d, Demand_Momentum:d",
          "FROM daily_prod", ctes=("daily_prod",))
def q_demand_momentum(spark, base):
    return ad.demand_momentum(ad.daily_product_items(_grain(spark, base)))


@register("daily_city_spend", "City, DateOnly, Daily_Spend:d",
          "FROM daily_spend", ctes=("daily_spend",))
def q_daily_city_spend(spark, base):
    return ad.spend_momentum(ad.daily_city_spend(_grain(spark, base)))


@register("spend_momentum", "City, DateOnly, Spend_7d:d, Spend_30d:d, Spend_Momentum:d",
          "FROM daily_spend", ctes=("daily_spend",))
def q_spend_momentum(spark, base):
    return ad.spend_momentum(ad.daily_city_spend(_grain(spark, base)))


@register("discount_elasticity",
          "Product, Avg_Items_Discount:d, Avg_Items_NoDiscount:d, Discount_Elasticity:d",
          "FROM discount", ctes=("discount",))
def q_discount(spark, base):
    return ad.discount_elasticity(_grain(spark, base))


@register("promo_avg", "Product, Promotion, Avg_Items:d", "FROM promo", ctes=("promo",))
def q_promo_avg(spark, base):
    return ad.promo_avg(_grain(spark, base))


@register("promo_lift", "Product, Promotion, Avg_Items:d, Baseline_Avg_Items:d, Promo_Lift:d",
          "FROM promo_lift", ctes=("promo_lift",))
def q_promo_lift(spark, base):
    return ad.promo_lift(ad.promo_avg(_grain(spark, base)))


@register("max_promo_lift", "Product, Max_Promo_Lift:d",
          "FROM promo_lift_prod", ctes=("promo_lift_prod",))
def q_max_promo_lift(spark, base):
    return ad.max_promo_lift(ad.promo_lift(ad.promo_avg(_grain(spark, base))))


@register("season_items", "Product, Season, Season_Items", "FROM season", ctes=("season",))
def q_season_items(spark, base):
    return ad.season_items(_grain(spark, base))


@register("seasonality_factor", "Product, Season, Season_Items, Seasonality_Factor:d",
          "FROM season", ctes=("season",))
def q_seasonality(spark, base):
    return ad.seasonality_factor(ad.season_items(_grain(spark, base)))


@register("city_activity", "City, City_Items, Avg_Spend:d, Discount_Rate:d, Transaction_Count",
          "FROM city", ctes=("city",))
def q_city_activity(spark, base):
    return ad.city_activity(_grain(spark, base))


@register("global_minmax",
          "City_Items_min, City_Items_max, Avg_Spend_min:d, Avg_Spend_max:d, Discount_Rate_min:d, "
          "Discount_Rate_max:d, Transaction_Count_min, Transaction_Count_max",
          "FROM city_stats", ctes=("city_stats",))
def q_global_minmax(spark, base):
    return global_minmax(ad.city_activity(_grain(spark, base)), ad.CITY_METRICS)


@register("minmax_plain",
          "City, City_Items_norm:d, Avg_Spend_norm:d, Discount_Rate_norm:d, Transaction_Count_norm:d",
          "FROM city_norm", ctes=("city_norm",))
def q_minmax_plain(spark, base):
    return ad.regional_activity(ad.city_activity(_grain(spark, base)))


@register("regional_activity", "City, Regional_Activity_Score:d", "FROM city_norm", ctes=("city_norm",))
def q_regional_activity(spark, base):
    return ad.regional_activity(ad.city_activity(_grain(spark, base)))


@register("distinct_base", "DateOnly, Product, City, Season", "FROM base", ctes=("base",))
def q_distinct_base(spark, base):
    return ad.distinct_base(_grain(spark, base))


_GOLD_COLS = ("DateOnly, Product, City, Season, Daily_Items, Items_7d, Items_30d, Demand_Momentum:d, "
              "Spend_Momentum:d, Discount_Elasticity:d, Max_Promo_Lift:d, Seasonality_Factor:d, "
              "Regional_Activity_Score:d")


@register("altdata_gold", _GOLD_COLS, "FROM gold", ctes=("gold",))
def q_gold(spark, base):
    """J2/J3 in reference mode: the spend join on the date alone fans out."""
    return signals(spark, base).gold(fixed=False)


@register("altdata_gold_fixed", _GOLD_COLS, "FROM gold_fixed", ctes=("gold_fixed",))
def q_gold_fixed(spark, base):
    return signals(spark, base).gold()


_NORMS = ", ".join(f"{c}_norm:d" for c, _ in ad.SIGNAL_WEIGHTS)


@register("minmax_half", "DateOnly, Product, City, Season, " + _NORMS,
          "FROM gold_fixed_scored", ctes=("gold_fixed_scored",))
def q_minmax_half(spark, base):
    return signals(spark, base).scored()


@register("retail_activity_score",
          "DateOnly, Product, City, Season, " + _NORMS + ", Retail_Activity_Score:d",
          "FROM gold_scored", ctes=("gold_scored",))
def q_retail_activity_score(spark, base):
    """G2 in reference mode, over the fan-out gold table."""
    return signals(spark, base).scored(fixed=False)


@register("retail_activity_score_fixed",
          "DateOnly, Product, City, Season, " + _NORMS + ", Retail_Activity_Score:d",
          "FROM gold_fixed_scored", ctes=("gold_fixed_scored",))
def q_retail_activity_score_fixed(spark, base):
    return signals(spark, base).scored()


@register("demand_momentum_calendar",
          "DateOnly, Product, Daily_Items, Items_7d, Items_30d, Demand_Momentum:d",
          "FROM daily_prod_calendar", ctes=("daily_prod_calendar",))
def q_demand_momentum_calendar(spark, base):
    """W1 with calendar frames (last 7 and 30 days) instead of row frames."""
    return ad.demand_momentum(ad.daily_product_items(_grain(spark, base)), calendar=True)
