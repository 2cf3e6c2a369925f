"""kinfold: unsupervised Bayesian entity resolution on Spark DataFrames."""
