"""hybridq.operators"""
