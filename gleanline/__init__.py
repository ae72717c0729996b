"""gleanline: review analytics and corpus preparation expressed as Spark plans."""
