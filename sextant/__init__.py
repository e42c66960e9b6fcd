"""Analytics on search-agent data and corpora, as Spark DataFrame operators."""
