"""Business records over the test tables: three sources, country, name, address and true links.

Every customer is one record. Four consecutive customers are an entity's reference record (S1) and two or three noisy
copies of it (S2, S3), or records of other businesses. Copies have another legal form, a typing error, another order of
words, an honorific, a domain, a Brahmic script, accents, an abbreviation, no address, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SYLLABLES = "ba,ce,di,fo,gu,ha,ke,li,mo,nu,pa,re,si,to,vu,za"
_CAPITALS = "Ba,Ce,Di,Fo,Gu,Ha,Ke,Li,Mo,Nu,Pa,Re,Si,To,Vu,Za"
_NATIVE_SYLLABLES = "बा,के,दि,फो,गु,हा,कि,ली,मो,नू,पा,रे,सी,तो,वु,ज़ा"
_NATIVE = "शिवम,गुरु,लक्ष्मी,गणेश,ಭಾರತ,ಕೃಷ್ಣ,సుందర్,কমল,વિજય,ਆਨੰਦ,துர்கா,ନନ୍ଦି"
_SECOND = "Willow,Harbor,Phoenix,Sheela,Chandra,Cedar,Bhavan,Monarch,Ganga,Khushi,Summit,Pooja,Garden,Raaga,Ghat,Jhelum,Thackeray,Dhanvi,Eiffel,Lumen,Azur,Bello,Wagon,Tymczak,Ashcraft,Pfister,Zephyr,Quince,Orchid,Lotus,Marble"
_KIND = "Traders,Services,Technology,Manufacturing,International,Jewellery,Foods,Solutions,Textiles,Pharma Systems,Logistics"
_FORM = "Pvt Ltd,Limited,LLP,Private Limited,Inc,LLC,Corp,SARL,SAS,Holdings"
_OTHER_FORM = "Private Limited,Ltd,LLP,Pvt. Ltd.,Incorporated,L.L.C,Corporation,EURL,SA,Group"
_SHORT_KIND = "Trdg,Svcs,Tech,Mfg,Intl,Jewellery,Foods,Solutions,Textiles,Pharm Sys,Logistics"
_STREET = "Nehru,Gandhi,Station,Market,Temple,Church,Lake,Mill,Victor Hugo,Jean Jaures,Highland,Oakwood,Mahatma,Residency,College,Sector"
_CITY = "Pune,Mumbai,Chennai,Nagpur,Jaipur,Boston,Denver,Austin,Lyon,Paris,Nantes,Lille"


def _pick(words: str, n: str) -> str:
    """SQL of the word of a list at a place that counts from 0 and starts again after the last."""
    return f"split_part('{words}', ',', CAST({n} % {len(words.split(','))} AS INT) + 1)"


def _coined(first: str, rest: str, n: str, syllables: int) -> str:
    """SQL of a word of syllables, the digits of n to the base 16: words grow with the records, so keys stay small."""
    return " || ".join(_pick(first if k == 0 else rest, f"CAST(floor({n} / {16**k}.0) AS BIGINT)") for k in range(syllables))


#: Common table expressions in the words that Spark and DuckDB share: e (records) and truth and spine of them.
ENTITIES = f"""
place AS (SELECT c_custkey AS k, CAST(floor(c_custkey / 4.0) AS BIGINT) AS g, c_custkey % 4 AS slot FROM customer),
noise AS (SELECT k, g, slot, CASE WHEN slot = 0 THEN 'S1' WHEN slot = 1 OR (slot = 3 AND g % 3 = 0) THEN 'S2' ELSE 'S3' END AS source,
    CASE WHEN slot = 0 THEN 0 ELSE (g * 5 + slot * 4) % 16 END AS t, CASE WHEN slot > 0 AND (g % 7 = 3 OR (slot = 3 AND g % 3 > 0)) THEN 0 ELSE 1 END AS linked FROM place),
seed AS (SELECT *, CASE WHEN linked = 1 THEN g ELSE g + 5003 * slot END AS s FROM noise),
mixed AS (SELECT *, (s * 7919 + 13) % 1048576 AS x, (s * 104729 + 7) % 1048576 AS y FROM seed),
words AS (SELECT *, {_coined(_CAPITALS, _SYLLABLES, "x", 4)} AS w1, {_pick(_NATIVE, "s")} || {_coined(_NATIVE_SYLLABLES, _NATIVE_SYLLABLES, "x", 3)} AS native, {_pick(_SECOND, "(s * 7 + 3)")} || {_coined(_SYLLABLES, _SYLLABLES, "y", 2)} AS w2, {_pick(_KIND, "(s * 3 + 1)")} AS kind, {_pick(_SHORT_KIND, "(s * 3 + 1)")} AS short_kind,
    {_pick(_FORM, "(s + CAST(floor(s / 10.0) AS BIGINT))")} AS form, {_pick(_OTHER_FORM, "(s + CAST(floor(s / 10.0) AS BIGINT))")} AS other_form, {_coined(_CAPITALS, _SYLLABLES, "y", 3)} || ' ' || {_pick(_STREET, "(s * 5)")} AS street, {_pick(_CITY, "(s * 11 + 2)")} AS city,
    CAST(s % 97 + 1 AS STRING) AS house, CAST(s * 13 % 380 + 3 AS STRING) AS plot, CAST(110001 + s * 37 % 80000 AS STRING) AS pin, CAST(10001 + s * 91 % 89000 AS STRING) AS zip,
    CASE WHEN g % 41 = 13 THEN NULL WHEN g % 5 < 2 THEN 'India' WHEN g % 5 = 2 THEN 'US' WHEN g % 5 = 3 THEN 'France' ELSE 'Brazil' END AS country FROM mixed),
named AS (SELECT *, CASE
    WHEN t = 1 THEN w1 || ' ' || w2 || ' ' || kind || ' ' || other_form
    WHEN t = 2 THEN w1 || ' ' || w2 || ' ' || kind
    WHEN t = 3 THEN substr(w1, 1, 2) || substr(w1, 4, 20) || ' ' || w2 || ' ' || kind || ' ' || form
    WHEN t = 4 THEN w2 || ', ' || w1 || ' ' || kind || ' ' || form
    WHEN t = 5 THEN 'M/s. ' || w1 || ' ' || w2 || ' ' || kind || ' ' || form
    WHEN t = 6 THEN 'www.' || lower(w1) || '-' || lower(w2) || '.co.in'
    WHEN t = 7 THEN native || ' ' || w2 || ' ' || kind || ' ' || form
    WHEN t = 9 THEN upper(w1 || '  ' || w2 || ' ' || kind || ' & ' || form)
    WHEN t = 10 THEN substr(w1, 1, 4) || substr(w2, 1, 1) || ' ' || kind || ' ' || form
    WHEN t = 11 THEN replace(replace(w1 || ' ' || w2 || ' ' || kind || ' ' || form, 'e', 'é'), 'a', 'à')
    WHEN t = 12 THEN w1 || ' ' || w2 || ' ' || house || ' ' || kind || ' a' || plot || 'b'
    WHEN t = 13 THEN w1 || ' ' || w2 || ' ' || short_kind || ' ' || form
    WHEN t = 14 THEN native || ' ' || w2
    WHEN t = 15 AND s % 2 = 0 THEN ' '
    WHEN t = 15 THEN NULL
    WHEN t = 0 AND s % 23 = 5 THEN 'The ' || w1 || ' ' || kind || ' and Co'
    WHEN t = 0 AND s % 23 = 6 THEN lower(w1) || lower(w2) || '.com - 02' || pin
    WHEN t = 0 AND s % 23 = 7 THEN native || ' ' || w2 || ' ' || kind || ' ' || form
    WHEN t = 0 AND s % 23 = 8 THEN w1 || ' ' || plot || ' ' || kind || ' ' || form
    ELSE w1 || ' ' || w2 || ' ' || kind || ' ' || form END AS business_name FROM words),
e AS (SELECT source || '-' || CAST(k AS STRING) AS entity_id, source, country, business_name, CASE
    WHEN t = 8 OR (t = 0 AND s % 29 = 11) THEN NULL
    WHEN t = 4 THEN street || ' Road, ' || city
    WHEN t = 3 AND country = 'US' THEN house || ' ' || street || ' St, Ste ' || plot || ', ' || city || ' ' || zip
    WHEN country = 'US' THEN house || ' ' || street || ' Street, Suite ' || plot || ', ' || city || ' ' || zip
    WHEN country = 'France' THEN CASE WHEN t = 9 THEN '0' ELSE '' END || house || ' Rue ' || street || ', ' || zip || ' ' || city
    WHEN t = 9 THEN street || ' Rd, Plot No.0' || plot || '/' || house || ', ' || city || ' - ' || pin
    WHEN t = 13 THEN street || ' Road, Plot No ' || plot || '/' || house || ', ' || city
    WHEN t = 1 THEN street || ' Road, H.No G-' || plot || ', Near Bank, ' || city || ' ' || pin
    WHEN s % 6 = 1 THEN house || ' ' || street || ' Road, Door No ' || plot || ', ' || city || ' ' || pin
    WHEN s % 6 = 2 THEN '#A-' || plot || ' ' || street || ' Rd, ' || city || ' ' || pin
    WHEN s % 6 = 3 THEN '8-' || plot || '/' || house || ', ' || street || ' Lane, Shop No-' || house || ', ' || city || ' ' || pin
    WHEN s % 6 = 4 THEN plot || 'b ' || street || ' Market, Flat ' || house || ', ' || city || ' ' || pin
    ELSE street || ' Road, Plot No ' || plot || '/' || house || ', ' || city || ' ' || pin END AS business_address, g, linked, slot FROM named),
truth AS (SELECT 'S1-' || CAST(4 * g AS STRING) AS s1_id, entity_id AS cand_id FROM e WHERE slot > 0 AND linked = 1),
spine AS (SELECT entity_id AS s1_id, country FROM e WHERE source = 'S1')"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, source, country, business_name, business_address, g (the entity), linked and slot of all customers."""
    text = ENTITIES.replace("FROM customer", "FROM {customer}")
    return spark.sql(f"WITH {text} SELECT * FROM e", customer=spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in two partitions a core at least: a table of few files or row groups is read by as few tasks, however much is made of its rows."""
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts, key)


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first source, and the other two together."""
    return rows.where("source = 'S1'"), rows.where("source <> 'S1'")


def true_links(rows: DataFrame) -> DataFrame:
    """s1_id and cand_id of the copies of an entity, at most three."""
    copies = rows.where("slot > 0 and linked = 1")
    return copies.select(F.concat(F.lit("S1-"), (4 * F.col("g")).cast("string")).alias("s1_id"), F.col("entity_id").alias("cand_id"))
