"""All registered queries of the marker engine, and their SQL."""

from tesserae.plans import images, measurements

QUERIES = {**images.QUERIES, **measurements.QUERIES}
SQL = {**images.SQL, **measurements.SQL}
