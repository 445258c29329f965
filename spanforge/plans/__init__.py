"""spanforge.plans"""
