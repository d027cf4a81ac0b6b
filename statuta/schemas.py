"""Fixed schemas; nothing is inferred."""

# Field names of the article files written by the earlier tool chain.
ARTICLE_JSON = ("kanun_no string, kanun_adi string, madde_no string, madde_tipi string, icerik string, "
                "bagli_kanun_no string, yonetmelik_adi string, source_type string")
