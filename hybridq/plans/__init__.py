"""hybridq.plans"""
