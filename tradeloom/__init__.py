"""Evidence-grounded economic supply-chain analytics on PySpark."""
