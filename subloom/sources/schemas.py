"""Column names and types of the monthly extracts, in file order."""

from __future__ import annotations

# The extracts have no header, so order and names are part of the format.
CHURN = {
    "t1": """MONTH_ID INT, USER_ID STRING, CUST_ID STRING, CUST_TYPE STRING, SERVICE_TYPE STRING,
        BRAND_ID STRING, AREA_ID STRING, USER_DIFF_CODE STRING, DEVICE_NUMBER STRING,
        NET_TYPE_CBSS STRING, SCORE_VALUE DOUBLE, CREDIT_CLASS STRING, BASIC_CREDIT_VALUE DOUBLE,
        CREDIT_VALUE DOUBLE, IS_ACCT STRING, PAY_MODE STRING, INNET_DATE STRING, OPER_DATE STRING,
        OPEN_MODE STRING, OPEN_DEPART_ID STRING, IN_DEPART_ID STRING, IS_LOST INT""",
    "t2": """MONTH_ID INT, PROV_ID STRING, USER_ID STRING, CUST_ID STRING, TOTAL_FEE DOUBLE,
        BASE_RENT_FEE DOUBLE, DINNER_RENT_FEE DOUBLE, FUNCATION_RENT_FEE DOUBLE,
        OTHER_RENT_FEE DOUBLE, BASE_CALL_FEE DOUBLE, COUN_LONG_LFEE DOUBLE, INTER_LONG_LFEE DOUBLE,
        GAT_LONG_LFEE DOUBLE, COUN_ROAM_BFEE DOUBLE, INTER_ROAM_BFEE DOUBLE, GAT_RAOM_BFEE DOUBLE,
        FUNCATION_FEE DOUBLE, WIRLESS_CARD_FEE DOUBLE, WLAN_FEE DOUBLE, CHARGE_FAV_FEE DOUBLE,
        ADJUST_FEE DOUBLE, DISCOUNT_FEE DOUBLE, GRANT_FEE DOUBLE""",
    "t3": """MONTH_ID INT, USER_ID STRING, FLUX_NUM DOUBLE, FREE_NUM DOUBLE, BILL_NUM DOUBLE,
        LOCAL_NUM DOUBLE, ROAM_PROV_NUM DOUBLE, ROAM_CONT_NUM DOUBLE, ROAM_GAT_NUM DOUBLE,
        ROAM_INT_NUM DOUBLE, TOTAL_FLUX DOUBLE, FREE_FLUX DOUBLE, BILL_FLUX DOUBLE,
        TOTAL_DURA DOUBLE, FREE_DURA DOUBLE, BILL_DURA DOUBLE, TOTAL_FEE_DATA DOUBLE,
        USER_ID_OLD STRING""",
    "t4": """CUST_ID STRING, CERT_TYPE STRING, CUST_SEX STRING, CUST_BIRTHDAY STRING,
        CONSTELLATION_DESC STRING, CERT_AGE DOUBLE, MONTH_ID INT""",
    "t5": """MONTH_ID INT, USER_ID STRING, DEPOSIT_MONEY DOUBLE, INIT_MONEY DOUBLE,
        ODD_MONEY DOUBLE, EVEN_MONEY DOUBLE, INVOICE_FEE DOUBLE, PRINT_FEE DOUBLE,
        START_CYCLE_ID INT, END_CYCLE_ID INT, OWE_FEE DOUBLE, VALID_FLAG STRING,
        FREEZE_FEE DOUBLE""",
    "t6": """MONTH_ID INT, DAY_ID INT, CUST_ID STRING, USER_ID STRING, CHANNEL_ID STRING,
        PAYMENT_ID STRING, RECV_FEE DOUBLE""",
}

_DEVICE = """HIS_IMEI{0} STRING, HIS_IMSI{0} STRING, HIS_FACTORY_ID{0} STRING,
        HIS_TERM_ID{0} STRING, HIS_FACTORY_DESC{0} STRING, HIS_TERM_DESC{0} STRING,
        HIS_CITY_NO{0} STRING, HIS_UP_TIME{0} DATE, HIS_IS_COPY{0} INT"""

REPLACEMENT = {
    "t1": ", ".join(
        ["MONTH_ID INT, MSISDN STRING, UP_TIME DATE", *[_DEVICE.format(i) for i in range(1, 6)]]
    ),
    "t2": """MONTH_ID INT, USER_ID STRING, DEVICE_NUMBER STRING, PRODUCT_CLASS STRING,
        IS_CARD STRING, IS_ADD STRING, ACCT_FEE DOUBLE, IS_ZNZD STRING, IS_AGREE STRING""",
    "t3": """MONTH_ID INT, USER_ID STRING, CUST_ID STRING, CUST_TYPE STRING, USECUST_ID STRING,
        SERVICE_TYPE STRING, BRAND_ID STRING, USER_DIFF_CODE STRING, DEVICE_NUMBER STRING,
        NET_TYPE_CBSS STRING, SCORE_VALUE DOUBLE, CREDIT_CLASS STRING, BASIC_CREDIT_VALUE DOUBLE,
        CREDIT_VALUE DOUBLE, IS_ACCT STRING, PAY_MODE STRING, INNET_DATE DATE, OPER_DATE STRING,
        OPEN_MODE STRING, USER_STATUS STRING, USER_STATUS_CBSS STRING, CHANNEL_ID STRING,
        CHANNEL_TYPE STRING, INNET_METHOD STRING, IS_INNET STRING, INNET_MONTHS DOUBLE""",
    "t4": """MONTH_ID INT, CUST_ID STRING, IS_INNET STRING, CHNL_ID STRING, CHNL_KIND_ID STRING,
        AREA_ID STRING, PAY_MODE STRING, CUST_SEX STRING, CERT_AGE DOUBLE,
        CONSTELLATION_DESC STRING""",
}

LOOKUPS = {
    "brand_up": "HIS_FACTORY_DESC1 STRING, BRAND_UP STRING",
    "phone_info": """HIS_FACTORY_DESC1 STRING, HIS_TERM_DESC1 STRING, product_time DATE,
        `2Gratio` DOUBLE, `3Gratio` DOUBLE, `4Gratio` DOUBLE, is_sp DOUBLE""",
}

# Columns read but not used afterwards.
UNUSED_CHURN = {
    "t1": """SERVICE_TYPE BRAND_ID USER_DIFF_CODE DEVICE_NUMBER NET_TYPE_CBSS BASIC_CREDIT_VALUE
        CREDIT_VALUE PAY_MODE OPEN_MODE OPEN_DEPART_ID IN_DEPART_ID""".split(),
    "t2": """PROV_ID GAT_LONG_LFEE FUNCATION_FEE WIRLESS_CARD_FEE WLAN_FEE CHARGE_FAV_FEE
        ADJUST_FEE DISCOUNT_FEE GRANT_FEE""".split(),
    "t3": "ROAM_PROV_NUM ROAM_GAT_NUM USER_ID_OLD".split(),
    "t4": "CUST_BIRTHDAY".split(),
    "t5": "VALID_FLAG FREEZE_FEE".split(),
    "t6": [],
}
UNUSED_REPLACEMENT = {
    "t1": [],
    "t2": "PRODUCT_CLASS IS_ADD".split(),
    "t3": """DEVICE_NUMBER CUST_TYPE USECUST_ID SERVICE_TYPE BRAND_ID USER_DIFF_CODE NET_TYPE_CBSS
        CREDIT_CLASS BASIC_CREDIT_VALUE CREDIT_VALUE PAY_MODE OPER_DATE OPEN_MODE USER_STATUS_CBSS
        CHANNEL_ID INNET_METHOD""".split(),
    "t4": "IS_INNET CHNL_ID PAY_MODE".split(),
}
