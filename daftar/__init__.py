"""daftar: statutory-text ETL, batch hybrid retrieval and citation audit on Spark DataFrames."""
