import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

RESUME = """Mira Okafor
Platform Engineer | Python, Java, AWS
Email: mira@example.org | Phone: +1-555-0177

SUMMARY
Platform engineer with 5+ years of experience in Python and cloud computing.
Proven track record of running scalable microservices.

EXPERIENCE
Senior Platform Engineer, Northwind Ltd
2020 - Present
- Led 10 people and built a cloud platform in Python
- Reduced deployment time through CI/CD

Platform Engineer, Contoso
2018 - 2020
- Migrated legacy systems to AWS
- Increased test coverage

EDUCATION
Bachelor of Science in Physics
University of Somewhere
2014 - 2018

SKILLS
Python, Java, Docker, k8s, AWS, postgres
"""

SKILLS = ["Python", "Java", "JavaScript", "Docker", "Kubernetes", "AWS", "PostgreSQL", "CI/CD",
          "Cloud Computing", "Microservices", "React", "React Native", "Node.js", "C++", "C#", "C",
          "Go", "SQL", "REST APIs", "Spark", "Apache", "Power BI", "GCP", "Generative AI"]

AS_OF = 2026


@pytest.fixture(scope="session")
def spark():
    from dossier.session import local_session

    # plans are searched for paths, which Spark cuts at 100 characters
    session = local_session(8, shuffle_partitions=4, **{"spark.sql.maxMetadataStringLength": "1000"})
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate an expression of a text column ``t`` (folded: ``f``) on one text."""
    from pyspark.sql import functions as F

    from dossier.functions.text import fold

    def run(make, text):
        df = spark.createDataFrame([(text,)], "t STRING").withColumn("f", fold(F.col("t")))
        return df.select(make(F.col("f")).alias("v")).first().v
    return run
