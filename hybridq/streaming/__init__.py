"""hybridq.streaming"""
