"""Schemas of the retail star and a required-column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
}


def _struct(spec: str) -> T.StructType:
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


TRANSACTIONS = _struct(
    "transaction_id:string business_day:date store_id:long product_id:long ean:string customer_id:long "
    "customer_key:string mobile:string amount:double quantity:double unit_price:double "
    "regular_unit_price:double actual_unit_price:double billed_amount:double transaction_type:string "
    "transaction_type_id:string loyalty_points:double redeemed_points:double "
    "forced_redemption_points:double mocd_flag:int bulk_sale_flag:int"
)
MATERIAL_MASTER = _struct(
    "material_id:long material_name:string brand:string material_group_id:long material_group_name:string "
    "category_id:long category_name:string department_id:long department_name:string "
    "department_class_id:int department_class_name:string"
)
STORE_MASTER = _struct(
    "store_id:long store_name:string region_name:string tayeb_flag:int broad_segment:string sub_segment:string"
)
CUSTOMER_PROFILE = _struct(
    "account_key:long customer_key:string card_key:long mobile:string email:string LHRDATE:date LHP:int "
    "nationality_group:string nationality_desc:string title_desc:string gender:string age:int "
    "accept_email_flg:int"
)
CUSTOMER_SEGMENTS = _struct(
    "customer_id:long key:string channel:string country:string month_year:int segment:string recency:int "
    "inter_purchase_time:double average_order_value:double total_orders:long total_spend:double"
)
GROSS_PROFIT = _struct(
    "country:string region:string year_month:int material_id:long gp_wth_chargeback:double "
    "gp_cost_of_goods_sold:double sales_wo_tax:double"
)
SALES_CAMPAIGN = _struct(
    "transaction_id:string business_date:string product_id:long campaign_id:string item_quantity:double "
    "item_amount:double pm_discount_amount:double pm_discount_media_type:string pm_campaign_group:string "
    "pm_reason_code:string void_flag:int store_id:long"
)
CAMPAIGN_AUDIENCE = _struct("campaign_id:int customer_key:string customer_id:long campaign_set:string")
CAMPAIGN_DELIVERY = _struct("campaign_id:int customer_key:string delivery_status:string campaign_channel:string")
CAMPAIGN_SALES = _struct(
    "campaign_id:int customer_id:long num_trans:long num_offer_trans:long total_spend:double "
    "total_offer_spend:double"
)
CAMPAIGN_DETAILS = _struct("campaign_id:int campaign_desc:string offer_threshold:double points_multiplier:double")
PROMO_EVENTS = _struct("start_date:date end_date:date event_theme:string")
WEATHER = _struct("region:string date:date temp:double rainfall:double")
HOLIDAYS = _struct("holiday_year:int holiday_date:date holiday_desc:string")
DELIST_LOG = _struct(
    "category_name:string material_group_name:string region_name:string material_id:long "
    "recommendation_date:date delisted_date:date confirmed_by:string"
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise ``ValueError`` naming the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
