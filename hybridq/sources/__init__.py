"""hybridq.sources"""
