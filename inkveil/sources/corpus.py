"""Inputs of the queries: the given tables, and a Dutch corpus derived from them.

The corpus is one letter for each customer, built by integer and string SQL that Spark and DuckDB read alike, so both
engines see the same text. Identifiers have right check digits but for planned exceptions.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST, _LAST = "Jan,Piet,Anna,Sofie,Karel,Fatma,Hugo", "Jansen,Bakker,Visser,Smit,Meijer,Mulder,Bos,Dekker,Peters,Hendriks,Dijkman"
_PARTICLES, _STREETS = ",,van ,de ,van der ", "Kerkstraat,Lindelaan,Oude Singel,Marktplein,Noordweg"
_TITLES = "wethouder,burgemeester,raadslid,beleidsmedewerker,projectleider"
_THEMES = "stikstof,parkeren,het klimaat,subsidies,geluidsoverlast,de begroting"
_CARDS = "4111 1111 1111 1111|5500 0000 0000 0004|4012-8888-8888-1881|4111 1111 1111 1112"
_TOWNS = "Utrecht,Zwolle,Gouda,Breda"

CORPUS_SQL = f"""
select k as doc_id, k % 4 as gm_code,
  'Van: ' || first || ' ' || particle || last || chr(10) || 'Aan: Gemeente ' || town || chr(10) || 'Onderwerp: ' || theme || chr(10) || chr(10)
  || case k % 3 when 0 then 'Geachte heer ' || last2 || ',' when 1 then 'Beste ' || first2 || ',' else 'Geachte mevrouw,' end || chr(10) || chr(10)
  || 'Mijn BSN is ' || bsn || ' en mijn rekening is ' || iban || '.' || chr(10)
  || 'Ik woon aan de ' || street || ' ' || cast(1 + k % 240 as string) || ', ' || cast(1000 + k % 8999 as string) || ' AB ' || town || '.' || chr(10)
  || 'Bel 06-' || cast(10000000 + (k * 31) % 89999999 as string) || ' of +31 20 ' || cast(100 + k % 900 as string) || ' ' || cast(1000 + k % 9000 as string) || ', of 0' || cast(10 + k % 80 as string) || ' ' || cast(200 + k % 700 as string) || ' ' || cast(10 + k % 90 as string) || ' ' || cast(10 + k % 89 as string) || '.' || chr(10)
  || 'Mail klant' || cast(k as string) || '@voorbeeld' || cast(k % 7 as string) || '.nl, zie https://www.voorbeeld.nl/zaak/' || cast(k as string) || '.' || chr(10)
  || case when k % 5 = 0 then 'KvK-nummer: ' || cast(10000000 + k as string) || chr(10) when k % 5 = 1 then 'Kamer van Koophandel   ' || cast(20000000 + k as string) || ' vestiging ' || cast(30000000 + k as string) || chr(10) else '' end
  || 'Kenteken AB-' || cast(10 + k % 90 as string) || '-CD en ' || cast(10 + k % 89 as string) || '-XYZ-' || cast(k % 10 as string) || '.' || chr(10)
  || 'Geboortedatum: ' || lpad(cast(1 + k % 31 as string), 2, '0') || '-' || lpad(cast(1 + k % 12 as string), 2, '0') || '-' || cast(1930 + k % 80 as string) || chr(10)
  || 'BTW NL' || bsn || 'B' || lpad(cast(k % 100 as string), 2, '0') || ', kaart ' || card || '.' || chr(10)
  || 'Klantnummer: ' || cast(100000 + k as string) || ', uw kenmerk Z-2023-' || cast(1000 + k as string) || ', zaaknummer onbekend.' || chr(10)
  || 'De ' || title || ' ' || initial || '. ' || particle || last2 || ' sprak met dhr. ' || particle || last || ' over ' || theme || '.' || chr(10)
  || case when k % 4 = 0 then 'De bewoner van nummer ' || cast(1 + k % 99 as string) || ' en huisnummer ' || cast(2 + k % 77 as string) || 'a klagen.' || chr(10) else '' end
  || case when k % 6 = 0 then 'Postbus ' || cast(100 + k % 900 as string) || ', ' || cast(1000 + k % 8999 as string) || ' AB ' || town || chr(10) else '' end
  || chr(10) || case k % 3 when 0 then 'Met vriendelijke groet,' when 1 then 'Hoogachtend,' else 'Groet, tot ziens' end || chr(10) || initial || '. ' || last || chr(10)
  || case when k % 2 = 0 then 'afdeling Publiek' || chr(10) || 'https://www.voorbeeld.nl/disclaimer' || chr(10) else '' end || 'Bijlage volgt' as text
from (
  select k, b8 || cast(chk % 10 as string) as bsn,
    case when k % 2 = 0 then 'NL' || lpad(cast(98 - m as string), 2, '0') || 'ABNA' || cast(acct as string)
         else 'NL' || lpad(cast(98 - m as string), 2, '0') || ' ABNA ' || substr(cast(acct as string), 1, 4) || ' ' || substr(cast(acct as string), 5, 4) || ' ' || substr(cast(acct as string), 9, 2) end as iban,
    split_part('{_FIRST}', ',', cast(1 + k % 7 as int)) as first, split_part('{_FIRST}', ',', cast(1 + (k + 3) % 7 as int)) as first2,
    split_part('{_LAST}', ',', cast(1 + k % 11 as int)) as last, split_part('{_LAST}', ',', cast(1 + (k * 5) % 11 as int)) as last2,
    split_part('{_PARTICLES}', ',', cast(1 + k % 5 as int)) as particle, split_part('{_STREETS}', ',', cast(1 + k % 5 as int)) as street,
    split_part('{_TITLES}', ',', cast(1 + k % 5 as int)) as title, split_part('{_THEMES}', ',', cast(1 + k % 6 as int)) as theme,
    split_part('{_CARDS}', '|', cast(1 + k % 4 as int)) as card, split_part('{_TOWNS}', ',', cast(1 + k % 4 as int)) as town, substr('ABCDEFGH', cast(1 + k % 8 as int), 1) as initial
  from (
    select k, b8, acct, (10112310 * cast(10000000000 as bigint) + acct) % 97 * 1000000 as part, ((10112310 * cast(10000000000 as bigint) + acct) % 97 * 1000000 + 232100) % 97 as m,
      (9 * cast(substr(b8, 1, 1) as int) + 8 * cast(substr(b8, 2, 1) as int) + 7 * cast(substr(b8, 3, 1) as int) + 6 * cast(substr(b8, 4, 1) as int) + 5 * cast(substr(b8, 5, 1) as int) + 4 * cast(substr(b8, 6, 1) as int) + 3 * cast(substr(b8, 7, 1) as int) + 2 * cast(substr(b8, 8, 1) as int)) % 11 as chk
    from (select c_custkey as k, cast(10000000 + (c_custkey * 7919) % 89999999 as string) as b8, cast(1000000000 + (c_custkey * 104729) % 899999999 as bigint) as acct from customer) a) b) c
"""
#: Dimension tables of the queries, in SQL that both engines read.
CONTACTS_SQL = "select 'email' as kind, 'klant' || cast(s_suppkey as string) || '@voorbeeld' || cast(s_suppkey % 7 as string) || '.nl' as value from supplier union all select 'postcode', cast(1000 + s_suppkey % 8999 as string) || 'AB' from supplier where s_suppkey % 3 = 0 union all select 'telefoon', '06' || cast(10000000 + (s_suppkey * 31) % 89999999 as string) from supplier where s_suppkey % 3 = 1 union all select 'adres', cast(1000 + s_suppkey % 8999 as string) || ' AB' from supplier where s_suppkey % 3 = 2"
OFFICIALS_SQL = f"select distinct n_nationkey % 4 as gm_code, split_part('{_LAST}', ',', cast(1 + n_nationkey % 11 as int)) as surname, substr('ABCDEFGH', cast(1 + n_nationkey % 8 as int), 1) as initials from nation"
TITLES = (("publiek", "wethouder", 0), ("publiek", "burgemeester", 1), ("publiek", "raadslid", 2), ("ambtenaar", "beleidsmedewerker", 3), ("ambtenaar", "projectleider", 4))
TITLES_SQL = "select * from (values " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in TITLES) + ") as t(list_name, title, ord)"
#: Review states that events cause: one event of a user changes a field of one detection.
EVENTS_SQL = "select event_id as seq, user_id % 200 as det_id, case event_type when 'click' then 'accepted' when 'purchase' then 'rejected' when 'view' then 'deferred' else 'pending' end as status, event_id % 7 = 0 as undone from events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores is dealt out to all of them, since what follows costs far more than reading
    it; a larger one stays as its files are split, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The rows of a statement over given tables; views are session-local and named for their folder."""
    for name in tables:
        view = f"{name}_{hashlib.md5(sf_dir.encode()).hexdigest()}"
        table(spark, sf_dir, name).createOrReplaceTempView(view)
        sql = re.sub(rf"\bjoin {name}\b", f"join {view} as {name}", re.sub(rf"\bfrom {name}\b", f"from {view}", sql))
    return spark.sql(sql)


def dutch_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gm_code, text."""
    return spread(derived(spark, sf_dir, CORPUS_SQL, "customer")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("gm_code").cast("int").alias("gm_code"), "text")
